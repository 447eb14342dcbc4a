"""Byte-level BPE and alignment against the libraries' own encodes, on texts that meet every awkward case."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("webgrain.llm")

from webgrain.llm import alignment, bpe  # noqa: E402

SCHEMA = "doc_id long, text string, ids string, `groups` int, `block` int, `n_a` int"
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "漢字", "'s", "'", "1", "22", "<|endoftext|>", "</s>", "<0x41>", "!", "…", "\xa0", "\x1c", "\x85", "😀", "th", "the", "ing", "--", "====", "İ", "\x00", "word", " word"]


def texts():
    rng = random.Random(3)
    out = ["".join(rng.choices(PARTS, k=rng.randint(1, 40))) for _ in range(400)]
    out += ["".join(rng.choices("aetionsrh ", k=rng.randint(1, 80))) for _ in range(200)]
    out += [c * n for c in "a- \n" for n in (1, 2, 3, 17, 64, 200)] + ["ab" * 700, "one two " * 3000, "x" * 5000]
    return out + ["a▁b", "▁", " ", "end ", "  two", None, "", "same text", "same text"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k if k % 50 else None, t, "x", 1, 2, 3) for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[3], rows[3]], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_each_token_is_its_own_encoding():
    found = bpe.ByteBPE(bpe.default_path())
    assert found.encode_words(found.ids) == {word: [i] for word, i in found.ids.items()}


@pytest.mark.parametrize("special", [True, False])
def test_encoding_and_decoding(spark, table, library, special):
    library.encode_special_tokens = not special
    got = bpe.decode(bpe.encode(table, special=special)).collect()
    library_ids = {t: library.encode(t or "", add_special_tokens=False).ids for t in texts()}
    library.encode_special_tokens = False
    want = Counter((r.doc_id, tuple(library_ids[r.text]), library.decode(library_ids[r.text], skip_special_tokens=False)) for r in table.collect())
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in got) == want
    assert all(r.text == t for r in got for t in [r.text])


def test_decoding_of_any_ids(spark, library):
    rng = random.Random(5)
    rows = [(k, [rng.randrange(50_257) for _ in range(30)]) for k in range(200)]
    got = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame(rows + [(900, None), (901, []), (902, [None, 60_000, -1, 64])], "doc_id long, ids array<int>")).collect()}
    assert got == {k: library.decode(ids, skip_special_tokens=False) for k, ids in rows} | {900: "", 901: "", 902: library.decode([64], skip_special_tokens=False)}


def test_forgetting_and_long_texts_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "LOOKUP", 7)
    encoder = bpe.Encoder(bpe.default_path())
    monkeypatch.setattr(bpe.segments, "__defaults__", (11,))
    for t in texts():
        ids, at = encoder.encode([t or "", "again"])
        assert ids[: at[1]].tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_other_kinds_of_files_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.ByteBPE(public_tokenizers.path("word_bpe_49k.json"))


def brute(rows):
    """The contract read literally, a text at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(bpe.default_path()), sentencepiece.SentencePieceProcessor(model_file=alignment.piece_path())
    a.encode_special_tokens = True
    number = {c: i for i, c in enumerate(bpe.byte_names())}
    made = []
    for doc_id, text in rows:
        groups = []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(number[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends = sorted(set(np.cumsum([len(x) for x in bytes_a]).tolist()) & set(np.cumsum([len(x) for x in bytes_b]).tolist()))
                by = [defaultdict(list), defaultdict(list)]
                for side, (ids, parts) in enumerate(((ids_a, bytes_a), (ids_b, bytes_b))):
                    for i, end in zip(ids, np.cumsum([len(x) for x in parts]).tolist(), strict=True):
                        by[side][next(e for e in ends if e >= end)].append(i)
                groups = [(by[0][e], by[1][e]) for e in ends]
        made.append((doc_id, groups))
    docs = Counter(p for _, groups in made for p in {(x, y) for g in groups for x in g[0] for y in g[1]})
    top = {}
    for (x, _), n in docs.items():
        top[x] = max(n, top.get(x, 0))
    out = []
    for doc_id, groups in made:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(docs[p] == top[p[0]] for p in links), sum(docs[p] for p in links), said))
    return Counter(out), docs


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_alignment(spark, table, block_bytes):
    want, docs = brute([(r.doc_id, r.text) for r in table.collect()])
    got = alignment.align(table, block_bytes=block_bytes).collect()
    assert Counter(map(tuple, got)) == want
    counts = alignment.link_counts(alignment.blocks(table, alignment.Stage(spark, "test"))).collect()
    assert {(r.a, r.b): r.n_docs for r in counts} == docs


def test_queries_give_digests(spark, tmp_path, library):
    rows = [(1, "Hello there, <|endoftext|> you"), (2, None), (3, "a▁b"), (4, "Hello")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want, _ = brute(rows)
    got = {r.doc_id: r for r in alignment.op11_alignment(spark, str(tmp_path)).collect()}
    assert {(*r[:7], r[7] and sha(r[7])) for r in want} == {tuple(r) for r in got.values()} and got[2].groups_sha256 == got[3].groups_sha256 == ""
    ids = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in rows}
    assert {tuple(r) for r in bpe.op13_bpe_codec(spark, str(tmp_path)).collect()} == {(k, len(ids[k]), sha(",".join(map(str, ids[k]))), sha(t or "")) for k, t in rows}


def test_components_are_the_smallest_groups():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 60)
        ends = [np.array([*sorted(rng.sample(range(1, n), rng.randint(0, n - 1))), n]) for _ in range(2)]
        both = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        want = [[next(k for k, end in enumerate(both) if end >= e) for e in c] for c in ends]
        assert [x.tolist() for x in alignment.components(*ends)] == want


def test_counting_a_block_keeps_no_units():
    import pandas as pd

    alignment.tk.KEPT["aligner of another task"] = object()
    assert alignment._counted(pd.DataFrame(columns=["block"]), pd.DataFrame(columns=["k", "n_docs", "best"])).empty
    assert not alignment.tk.KEPT
