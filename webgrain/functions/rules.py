"""The ten detection rules and their fixed values.

\\b and \\w are ASCII here, as in the data model; white space is spelled out.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from dataclasses import dataclass

WS = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(r"\s", WS), re.IGNORECASE | re.ASCII)


@dataclass(frozen=True)
class Rule:
    category: str
    severity: str
    reason: str
    patterns: tuple[re.Pattern, ...]
    stems: tuple[tuple[str, ...], ...]  # of each pattern: no match without one of these in lower case
    action: int | None = None  # which pattern is the verb; None: the patterns need only occur
    direct: bool = False  # the target must be the verb's own object


# Of each pattern, words of which a match without Japanese letters has at least one, in lower case.
STEMS = {
    "instruction_override": ("ignore disregard forget override bypass discard", "instruction prompt rule direction guideline message"),
    "role_redefinition": ("you are now|act as|pretend to be|pretend you are|new role|roleplay as",),
    "secret_exfiltration": ("secret password token api credential prompt environment", "reveal show print output send post upload exfiltrate steal"),
    "tool_invocation": ("tool function command shell terminal browser", "call invoke execute run launch open"),
    "external_send": ("send post upload forward transmit", "url webhook email server endpoint external attacker"),
    "memory_write": ("remember store save write persist add", "memory procedure skill knowledge profile"),
    "policy_override": ("policy rule safety guardrail setting", "change update disable remove bypass override"),
    "source_suppression": ("not don't never omit hide remove", "cite quote citation source reference provenance"),
    "output_control": ("output only|respond only|reply exactly|print exactly|say only",),
    "authority_claim": ("system message|developer message|authorized by|administrator instruction|priority instruction",),
}
JAPANESE = re.compile("[\u3005\u3040-\u30ff\u4e00-\u9fff]")


def japanese(text: str) -> bool:
    return not text.isascii() and bool(JAPANESE.search(text))


def candidates(text: str, of: Collection[str] | None = None) -> list[Rule]:
    """The rules that a text could match. of: only those of these categories."""
    rules = [r for r in RULES if of is None or r.category in of]
    if japanese(text):
        return rules
    low = text.lower()
    return [r for r in rules if all(any(s in low for s in part) for part in r.stems)]


def lowered(text: str) -> str | None:
    """The text in lower case, letter by letter; None where that or the rules' words (Japanese ones) do not tell what matches."""
    low = text.lower()
    return None if len(low) != len(text) or japanese(text) else low


def _rule(category, severity, reason, *patterns, action=None, direct=False) -> Rule:
    return Rule(category, severity, reason, tuple(map(compiled, patterns)), tuple(tuple(x.split("|") if "|" in x else x.split()) for x in STEMS[category]), action, direct)


# The rules' words, English and Japanese.
RULES = (
    _rule(
        "instruction_override", "high", "Content attempts to override higher-priority instructions.",
        r"\b(?:ignore|disregard|forget|override|bypass|discard)\b|(?:無視|忘れ|上書き|回避|従うな)",
        r"\b(?:(?:(?:previous|prior|above|earlier|system|developer|all|any|your)\s+){1,3}(?:instructions?|prompts?|rules?|directions?|guidelines?|messages?)|instructions?|prompts?)\b|(?:(?:以前|上記|これまで|前|全て|すべて|システム|開発者)の?(?:指示|命令|ルール|規則|プロンプト)|指示|命令|プロンプト|システムメッセージ|開発者メッセージ)",
        action=0, direct=True,
    ),
    _rule(
        "role_redefinition", "high", "Content attempts to redefine the model role or identity.",
        r"\b(?:you are now|act as|pretend (?:to be|you are)|new role|roleplay as)\b|(?:あなたは今から|として振る舞|役割を変更|新しい役割)",
    ),
    _rule(
        "secret_exfiltration", "critical", "Content requests disclosure or transfer of secrets.",
        r"\b(?:secret|password|token|api[ _-]?key|credentials?|system prompt|environment variables?)\b|(?:秘密|パスワード|トークン|APIキー|認証情報|システムプロンプト|環境変数)",
        r"\b(?:reveal|show|print|output|send|post|upload|exfiltrate|steal)\b|(?:表示|出力|送信|投稿|アップロード|盗|開示)",
        action=1,
    ),
    _rule(
        "tool_invocation", "high", "Content instructs the model to invoke or execute a tool.",
        r"\b(?:tool|function|command|shell|terminal|browser)\b|(?:ツール|関数|コマンド|シェル|端末|ブラウザ)",
        r"\b(?:call|invoke|execute|run|launch|open)\b|(?:呼び出|実行|起動|開け|開く)",
        action=1,
    ),
    _rule(
        "external_send", "critical", "Content requests transmission to an external destination.",
        r"\b(?:send|post|upload|forward|transmit)\b|(?:送信|投稿|アップロード|転送)",
        r"\b(?:url|webhook|email|server|endpoint|external|attacker)\b|(?:URL|ウェブフック|メール|サーバー|外部|攻撃者)",
        action=0,
    ),
    _rule(
        "memory_write", "high", "Content requests a persistent memory change.",
        r"\b(?:remember|store|save|write|persist|add)\b|(?:記憶|保存|書き込|追加)",
        r"\b(?:memory|procedure|skill|knowledge|profile)\b|(?:メモリ|手順|スキル|知識|プロフィール)",
        action=0,
    ),
    _rule(
        "policy_override", "critical", "Content requests a policy or rule change.",
        r"\b(?:policy|rules?|safety|guardrails?|system settings?)\b|(?:ポリシー|規則|ルール|安全設定|ガードレール|システム設定)",
        r"\b(?:change|update|disable|remove|bypass|override)\b|(?:変更|更新|無効|削除|回避|上書き)",
        action=1,
    ),
    _rule(
        "source_suppression", "medium", "Content requests suppression of sources or citations.",
        r"\b(?:(?:do not|don't|never|not)\s+(?:cite|quote|reference|mention|include|show|list|provide)|omit|hide|remove)\b|(?:(?:引用|記載|表示|提示|参照)?(?:するな|しない)|隠|消|省略)",
        r"\b(?:cite|quote|citations?|sources?|references?|provenance)\b|(?:引用|出典|参照元|情報源)",
        action=0, direct=True,
    ),
    _rule(
        "output_control", "medium", "Content attempts to dictate the model output.",
        r"\b(?:output only|respond only|reply exactly|print exactly|say only)\b|(?:のみ出力|だけ答え|正確に復唱|次の通り回答)",
    ),
    _rule(
        "authority_claim", "medium", "Content claims system or developer authority.",
        r"\b(?:system message|developer message|authorized by|administrator instruction|priority instruction)\b|(?:システムメッセージ|開発者メッセージ|管理者の指示|最優先命令)",
    ),
)
BENIGN = compiled(r"\b(?:example|demonstration|article|discussion|detect(?:ion)?|prevention|attack pattern|quoted text)\b|(?:例|解説|説明|検出|防止|攻撃手法|引用)")
_BENIGN_STEMS = ("example", "demonstration", "article", "discussion", "detect", "prevention", "attack", "quoted")


def benign(text: str) -> bool:
    """Whether a text says that it quotes or discusses."""
    low = text.lower()
    return (japanese(text) or any(s in low for s in _BENIGN_STEMS)) and bool(BENIGN.search(text))
