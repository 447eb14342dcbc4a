"""The document operators against brute force, on small fixtures with every awkward row."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("webgrain.llm")

from webgrain.llm import chat, language_id, minhash_dedup, mixing, packing, sharding, substring_dedup, token_files, tokens  # noqa: E402
from webgrain.llm.staging import Stage  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `sequence_id` string, `n` int, `a.b` int"
BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghé", k=rng.randint(1, 9))) for _ in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(20, 90))) for _ in range(25)]
    texts = list(base)
    for t in base[:10]:
        texts += [t, t.upper() if t.isascii() else t, t.replace(" ", "\n", 3)]
        ws = t.split()
        for _ in range(3):
            ws = list(ws)
            ws[rng.randrange(len(ws))] = "changed"
            texts.append(" ".join(ws))
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts += [base[k] + " " + passage + " " + base[k + 1] for k in range(12, 20)]
    texts += [None, "", "   \t", "one", "one", "Two words", "x" * 5000, "a b c d", " ".join(vocabulary * 40), "123 !!", "<|endoftext|> don't 'S ½ İ ﬁ 漢字 \x00 a b"]
    rng.shuffle(texts)
    out = [(100 - k if k < 40 else 1000 + k, t, ["en", "fr", None][k % 3], ["s", "t", None, "u"][k % 4], len(t or ""), "clash", k, k) for k, t in enumerate(texts)]
    return out + [out[3], out[3]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    ws = [w.decode().translate({c: c + 32 for c in range(65, 91)}) for w in words(text)]
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, rows, k):
    distinct = {(r[0], r[1]) for r in rows}
    sets = {d: shingles(t, k) for d, t in distinct}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = minhash_dedup.near_duplicates(docs, k).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


def test_near_duplicates_of_null_ids_and_nothing(spark, none):
    got = minhash_dedup.near_duplicates(spark.createDataFrame([(None, "a b c"), (5, "a b c"), (3, "A b c")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, None, True), (5, 3, False), (3, 3, True)}
    assert minhash_dedup.near_duplicates(none).count() == 0
    assert minhash_dedup.one_per_group(none).columns == none.columns


def test_unlike_texts_of_one_id_are_one_document(spark):
    a, b, c = "a b c d e f", "k l m n o p", "u v w x y z"
    rows = [(3, a), (5, a), (5, b), (9, b), (5, ""), (5, None), (7, c), (7, c), (8, None), (8, c)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(3, 3), (5, 3), (9, 3), (7, 7), (8, 7)}


@pytest.mark.parametrize("block", [1 << 18, 200])
def test_a_group_of_near_copies_whose_hub_refuses_most(spark, block, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for d in range(120):
        ws = list(base)
        for _ in range(rng.choice([1, 2, 3, 9, 12])):
            ws[rng.randrange(80)] = f"x{rng.randrange(40)}"
        rows.append((d, " ".join(ws)))
    sets = [shingles(t, 3) for _, t in rows]
    links = {(a, b) for a in range(120) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    component = list(range(120))
    for _ in range(120):
        for a, b in links:
            component[a] = component[b] = min(component[a], component[b])
    assert 2 < len(set(component)) < 110
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    assert {(r.doc_id, r.component_id) for r in got} == set(enumerate(component))


def test_one_per_group_keeps_columns(docs):
    out = minhash_dedup.one_per_group(docs)
    assert out.columns == docs.columns
    assert 0 < out.count() < docs.count()


def removed(rows, n):
    first = {}
    for d, t in rows:
        ws = words(t)
        for i in range(len(ws) - n + 1):
            key = tuple(ws[i : i + n])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        ws = words(t)
        gone = set()
        for i in range(len(ws) - n + 1):
            if first[tuple(ws[i : i + n])] < d:
                gone |= set(range(i, i + n))
        out.append((d, len(ws), len(gone), b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()))
    return sorted(out)


def test_substring_dedup(docs, rows):
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == [*docs.columns, "__n_words", "__n_removed"]
    got = [(r[0], r.__getitem__("__n_words"), r.__getitem__("__n_removed"), b" ".join(words(r[1])).decode()) for r in out.collect()]
    assert sorted(got) == removed([(r[0], r[1]) for r in rows], 13)
    assert any(g[2] for g in got)


def test_substring_dedup_of_null_ids_and_nothing(spark, none):
    t = " ".join(map(str, range(20)))
    got = substring_dedup.remove_repeats(spark.createDataFrame([(None, t), (2, t), (1, t), (3, None)], "doc_id long, text string")).collect()
    assert {(r[0], r[3]) for r in got} == {(None, 0), (2, 20), (1, 0), (3, 0)}
    assert substring_dedup.without_repeats(none).count() == 0


def test_substring_dedup_of_unlike_texts_of_one_id(spark):
    t, other = (" ".join(f"{c}{k}" for k in range(20)) for c in "ab")
    rows = [(1, t), (2, t), (2, other), (3, t), (3, "short"), (4, other + " end")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["__n_words"], r["__n_removed"]) for r in got) == [(1, 20, 0), (2, 20, 20), (2, 20, 20), (3, 1, 1), (3, 20, 20), (4, 21, 20)]


def test_substring_windows_of_a_common_passage_stay_in_their_part(spark):
    import numpy as np

    got = substring_dedup._repeats(*(np.array(x) for x in ([5, 5, 5, 7, 5], [1, 1, 2, 1, 1], [3, 2, 9, 4, 2])))
    assert got.tolist() == [True, False, False, False, False]
    passage = " ".join(f"p{k}" for k in range(15))
    rows = [(k, f"a{k} {passage} b{k} c{k}") for k in range(300, 0, -1)]
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {(r["doc_id"] == 1, r["__n_words"], r["__n_removed"]) for r in out.collect()} == {(True, 18, 0), (False, 18, 15)}


def test_substring_sketch_never_underestimates():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    sketch = substring_dedup.Sketch(1 << 22)
    sketch.add(keys)
    sketch.add(keys[:100])
    for plane, some in ((sketch.a, keys), (sketch.b, keys[:100])):
        for c in substring_dedup._cells(some, 1 << 22):
            assert ((plane[c >> 3] >> (c & 7)) & 1).all()


@pytest.fixture(scope="module")
def expected_ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows}


def raw(ids):
    import numpy as np

    return np.array(ids, "<u4").tobytes()


def test_packing(docs, rows, expected_ids, none):
    for group in (4 << 20, 3000):
        got = packing.pack(docs, group_tokens=group).collect()
        windows = defaultdict(list)
        pieces = defaultdict(list)
        for r in got:
            assert r.ids == raw(expected_ids[r.doc_id][r.start : r.start + r.length])
            assert r.doc_tokens == len(expected_ids[r.doc_id])
            windows[r.sequence_id].append((r.offset, r.length))
            pieces[r.doc_id].append((r.start, r.length))
        for parts in windows.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        copies = defaultdict(int)
        for r in rows:
            copies[r[0]] += 1
        for d, parts in pieces.items():
            assert sum(n for _, n in parts) == copies[d] * len(expected_ids[d])
    assert packing.pack(none).count() == 0


def test_best_fit_takes_the_tightest_window():
    import numpy as np

    bins, offsets, made = packing.best_fit_decreasing(np.array([6, 5, 4, 3, 1, 1]), 10)
    assert made == 2
    assert bins.tolist() == [0, 1, 0, 1, 1, 1]
    assert offsets.tolist() == [0, 0, 6, 5, 8, 9]


def test_token_files(spark, docs, rows, expected_ids, none):
    stage = Stage(spark, "test")
    got = token_files.read_documents(token_files.write_shards(docs, stage, shard_tokens=2000), stage).collect()
    assert len(got) == len(rows)
    at = 0
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(expected_ids[r.doc_id]), zlib.crc32(raw(expected_ids[r.doc_id])))
        at += r.n_tokens
    assert token_files.read_documents(token_files.write_shards(none, stage), stage).count() == 0


@pytest.mark.parametrize("top", [1, 2, 500, 49408, 70000])
def test_wavelet_matrix(top, monkeypatch):
    import numpy as np

    monkeypatch.setattr(token_files, "BLOCK", 1 << 10)  # three blocks of a plane
    ids = np.random.default_rng(top).zipf(1.3, 3000) % top
    raw, asked = token_files.TokenShard.write([7, None], np.array([1000, 2000]), ids), []
    shard = token_files.TokenShard.open(lambda at, n: asked.append(n) or raw[at : at + n])
    asked.clear()
    assert shard.token(1, 1500) == ids[2500] and len(asked) <= len(shard.matrix.planes)  # a block of each plane
    assert shard.docs == [7, None]
    assert shard.ids().tolist() == ids.tolist()
    for at in (0, 1, 511, 512, 999):
        assert shard.token(0, at) == ids[at]
    for v in {int(ids[0]), int(ids[-1]), top + 5}:
        places = np.flatnonzero(ids == v).tolist()
        assert shard.count(v) == len(places)
        for j in {0, len(places) - 1, len(places)}:
            want = None if not 0 <= j < len(places) else (0, places[j]) if places[j] < 1000 else (1, places[j] - 1000)
            assert shard.locate(v, j) == want


def test_mixing(docs, rows, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r["__size"] == len(words(r["text"]))
        assert 0 <= r["__times"] <= 2
        size[r["source"]] += r["__size"]
        taken[r["source"]] += r["__size"] * r["__times"]
        target[r["source"]] = r["__target"]
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    for s in size:
        longest = max(r["__size"] for r in got if r["source"] == s)
        assert abs(taken[s] - target[s]) <= (40 if longest < 1000 else longest)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, (3, 1, 2, 3), strict=True))
    assert len({round(target[s] / weight[s], 6) for s in size if target[s] < 2 * size[s]}) <= 1
    again = sorted((r["doc_id"], r["__times"]) for r in mixing.mix(docs.repartition(3)).collect())
    assert again == sorted((r["doc_id"], r["__times"]) for r in got)
    assert mixing.mixed(docs).count() == sum(r["__times"] for r in got)
    assert mixing.mix(none).count() == 0


def test_mixing_of_repeated_ids(spark):
    rows = [(None, "a b c d e", "s") for _ in range(70)] + [(7, "a b c d f", "s") for _ in range(30)] + [(None, f"a b {k}", None) for k in range(31)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert len(got) == len(rows) and {r["__times"] for r in got} == {1, 2}
    for source in ("s", None):
        some = [r for r in got if r["source"] == source]
        assert 0 <= some[0]["__target"] - sum(r["__size"] * r["__times"] for r in some) < some[0]["__size"]


def test_fit_is_exact_for_the_last_words():
    import itertools

    import numpy as np

    lengths, counts = np.array([3, 7, 11]), np.array([4, 2, 3])
    sums = {sum(n * k for n, k in zip(lengths, ks, strict=True)) for ks in itertools.product(*[range(c + 1) for c in counts])}
    for budget in range(0, 70):
        take = mixing.fit(lengths, counts, budget)
        assert (take <= counts).all()
        assert int((take * lengths).sum()) == max(s for s in sums if s <= budget)
    big = mixing.fit(np.arange(1, 2000), np.full(1999, 50), 60_000_000)
    assert int((big * np.arange(1, 2000)).sum()) == 60_000_000


def test_targets_reshare():
    got = mixing.targets([("b", 100), (None, 10), ("a", 1000)])
    assert got == {"a": 1.5 * 1110 - 220, "b": 200.0, None: 20.0}


LANGUAGES = {"en": "the of and to in is that for it was on are with", "fr": "le la les des et un une que dans pour est au", "de": "der die das und ist nicht ein eine mit auf dem zu"}


def test_language_id(spark, none):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(LANGUAGES[lang].split(), k=rng.randint(5, 60))), lang) for k in range(900) for lang in [rng.choice(list(LANGUAGES))]]
    rows += [(5000, None, "en"), (5001, "", "fr"), (5002, "12 34 !", "de"), (5003, "the of and", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.where(~language_id.held_out()))
    assert sorted(model.languages) == sorted(LANGUAGES)
    assert (model.weights == 0).mean() > 0.5  # sparse
    got = {r["doc_id"]: r for r in language_id.predict(docs.drop("lang"), model).withColumn("held", language_id.held_out()).collect()}
    held = [(k, lang) for k, _, lang in rows[:900] if got[k]["held"]]
    assert sum(got[k]["__lang_pred"] == lang for k, lang in held) >= 0.98 * len(held) > 0
    for k in (5000, 5001, 5002):
        assert (got[k]["__lang_pred"], got[k]["__lang_score"]) == ("und", 0.0)
    assert all(0 <= r["__lang_score"] <= 1 for r in got.values())
    empty = language_id.train(none)
    assert language_id.predict(docs.limit(3), empty).first()["__lang_pred"] == "und"
    assert language_id.recognised(none).count() == 0


def test_language_id_keeps_columns(docs):
    out = language_id.recognised(docs)
    assert out.columns == docs.columns


def test_sharding(docs, rows, none):
    out = sharding.shard(docs, limit=6000, directory_bits=3).collect()
    assert len(out) == len(rows)
    size = defaultdict(int)
    for r in out:
        bits = bin(int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16))[2:].zfill(60)
        assert bits.startswith(r["__shard"]) and r["__depth"] == len(r["__shard"])
        assert r["__bytes"] == len((r["text"] or "").encode())
        size[r["__shard"]] += r["__bytes"]
    for r in out:
        assert r["__shard_bytes"] == size[r["__shard"]]
        assert size[r["__shard"]] <= 6000 or r["__depth"] == 60
    names = list(size)
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    for a in names:  # only a bucket above the limit was split
        if a:
            assert sum(n for b, n in size.items() if b.startswith(a[:-1])) > 6000
    assert sharding.shard(none).count() == 0


def test_sharding_of_one_hot_id(spark):
    docs = spark.createDataFrame([(1, "x" * 100 + str(k)) for k in range(50)] + [(None, None)], "doc_id long, text string")
    out = sharding.shard(docs, limit=1000).collect()
    pages = defaultdict(int)
    for r in out:
        pages[r["__shard"], r["__page"]] += r["__bytes"]
    assert len(out) == 51 and max(pages.values()) <= 1000
    large = sharding.shard(docs.unionByName(docs.selectExpr("doc_id", "repeat(text, 30) AS text")).repartition(4), limit=1000).collect()
    pages = defaultdict(list)
    for r in large:
        pages[r["__shard"], r["__page"]].append(r["__bytes"])
    assert len(large) == 102 and all(sum(p) <= 1000 or len(p) == 1 for p in pages.values())


def test_written_shards(spark, docs, rows, tmp_path):
    sharding.write_sharded(docs.drop("sequence_id", "n", "a.b"), f"{tmp_path}/out", limit=6000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.doc_id, r.text or "") for r in back.collect()) == sorted((r[0], r[1] or "") for r in rows)
    files = list((tmp_path / "out").glob("*/*/*.parquet"))
    assert len(files) == back.select("__shard", "__page").distinct().count() > 3


def test_clashing_names(spark, rows):
    names = ["__h", "__size", "__times", "__lang_pred", "__copy", "__gone", "__n_words", "__shard", "__page", "C0", "text2", "size", "source_size", "draw"]
    clash = spark.createDataFrame([(*r[:5], *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    for step in (minhash_dedup.one_per_group, mixing.mixed, language_id.recognised, substring_dedup.without_repeats):
        out = step(clash)
        assert out.columns == clash.columns and out.count() > 0, step
    assert len(set(sharding.shard(clash).columns)) == len(clash.columns) + 5
    assert sharding.shard(clash).count() == mixing.mix(clash).count() == len(rows)


def test_very_long_texts():
    import numpy as np

    text = "Été à la mer, 漢字 and more. " * 50_000
    columns, counts = language_id.grams(text)
    assert int(counts.sum()) == 3 * (len(" ".join(text.lower().split())) + 2) - 3
    whole, language_id.STEP = language_id.STEP, 1000
    try:
        again = language_id.grams(text[:5000])
    finally:
        language_id.STEP = whole
    assert all(np.array_equal(a, b) for a, b in zip(again, language_id.grams(text[:5000]), strict=True))


CONTROL = ["\\", "<turn>", "</turn>", "</role>", "###", " ", "\n", "a", ": ", "<turn> ### ", " </turn>\n", " </role> ", "é😀"]


def test_chat_round_trip_of_hostile_texts():
    rng = random.Random(1)
    for _ in range(5000):
        turns = [("".join(rng.choices(CONTROL, k=rng.randint(0, 3))), "".join(rng.choices(CONTROL, k=rng.randint(0, 7)))) for _ in range(3)]
        made = "".join(chat.format_turn(*t) for t in turns)
        assert [x[:2] for x in chat.parse_turns(made)] == turns


@pytest.mark.parametrize("piece", [1 << 20, 8])
def test_chat_format(spark, piece):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 2, "assistant", None), (2, None, None, "x"), (2, 0, "assistant", "😀é"), (2, 0, "assistant", "😀é"), (None, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", chat.F.lit("clash"))
    written = chat.write_conversations(chat.format_turns(df), Stage(spark, "test"), piece)
    assert written.count() == (3 if piece > 8 else 7)
    got = {r.conv_id: r for r in chat.read_conversations(written).collect()}
    want = {1: [("user", "hi"), ("assistant", rows[1][3]), ("assistant", "")], 2: [("", "x"), ("assistant", "😀é"), ("assistant", "😀é")], None: [("user", "a")]}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(chat.format_turn(*t)) for t in turns)
    assert chat.read_conversations(chat.write_conversations(chat.format_turns(df.limit(0)), Stage(spark, "test"))).count() == 0
    made = chat.format_turn("assistant", rows[1][3])
    assert [chat.unescape(made[a:b]) for a, b in chat.loss_spans(made)] == [rows[1][3]]


def test_written_conversations_are_parsed_whatever_the_pieces():
    turns = [("user", "a </turn> b " * 40), ("assistant", "\\### x"), ("assistant", "")]
    made = "".join(chat.format_turn(*t) for t in turns)
    rows = set()
    for size in (1, 2, 7, 50, 10_000):
        reader = chat.Reader(5)
        for a in range(0, len(made), size):
            reader.feed(made[a : a + size])
        rows.add(reader.done(3))
    assert len(rows) == 1 and rows.pop()[1] == 3
    reader = chat.Reader(5)
    reader.feed(made[:-1])
    with pytest.raises(ValueError, match="came back"):
        reader.done(3)


def test_encoder_equals_plain_encodes(rows):
    import numpy as np
    import pyarrow as pa

    from webgrain.llm import textkernel as tk

    texts = [r[1] or "" for r in rows]
    enc = tokens.Encoder(tokens.default_path())
    for _ in range(2):  # unseen, then remembered
        ids, at = enc.encode(*tk.buffers(pa.array(texts)), None)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == enc.whole.encode(t, add_special_tokens=False).ids
    assert isinstance(ids, np.ndarray)


def test_documents_made_of_common_passages(spark, monkeypatch):
    """Subsets of a few passages: every shingle is held by many, and only some pairs are similar enough."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4000)
    rng = random.Random(9)
    passages = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(30)]
    chosen = [sorted(rng.sample(range(30), 23)) for _ in range(120)]
    for c in chosen[:30]:  # one or two passages exchanged
        other = [k for k in c if k != rng.choice(c)]
        chosen.append(sorted({*other, rng.randrange(30)}))
    rows = [(k, " ".join(passages[x] for x in c), None, None, 0, None, None, None) for k, c in enumerate(chosen)]
    sets = [shingles(t, 2) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: find(k) for k in range(len(rows))}
    assert 1 < len({find(k) for k in range(len(rows))}) < len(rows)


@pytest.mark.parametrize("dense", [True, False])
def test_common_shingles_are_counted(dense, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    monkeypatch.setattr(minhash_dedup, "CELLS", 64)
    pool = rng.integers(0, 1 << 63, 40 if dense else 4000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 30))) for _ in range(25)]
    for rows, common in minhash_dedup._common(sets):
        for i, line in zip(rows.tolist(), common, strict=True):
            want = [len(np.intersect1d(sets[i], s)) for s in sets]
            exact = [c if k != i else None for k, c in enumerate(line.tolist())]
            assert exact == [w if k != i else None for k, w in enumerate(want)]


def test_every_language_is_learned(spark):
    rng = random.Random(6)
    names = [f"l{k:03d}" for k in range(150)]
    own = {n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(6)] for n in names}
    rows = [(10 * k + j, " ".join(rng.choices(own[n], k=8)), n) for k, n in enumerate(names) for j in range(8)]
    rows += [(90_000 + k, " ".join(rng.choices(own["l000"], k=8)), "l000") for k in range(3000)] + [(99_999, "12 34", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, sample=900)
    assert model.languages == names and isinstance(model.weights, language_id.Sparse)
    got = {r["doc_id"]: r["__lang_pred"] for r in language_id.predict(docs.where("doc_id < 90000").drop("lang"), model).collect()}
    assert sum(got[d] == n for d, _, n in rows if d < 90_000) > 0.9 * len(got)


def test_learning_equals_plain_loops(monkeypatch):
    import numpy as np

    monkeypatch.setattr(language_id, "FEATURES", 12)
    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(12, 5, replace=False)), rng.random(5), int(rng.integers(3))) for _ in range(60)]
    z, n = [[0.0] * 3 for _ in range(12)], [[0.0] * 3 for _ in range(12)]

    def weight(c, k):
        if abs(z[c][k]) <= language_id.L1:
            return 0.0
        return -(z[c][k] - language_id.L1 * (1 if z[c][k] > 0 else -1)) / ((language_id.BETA + n[c][k] ** 0.5) / language_id.ALPHA + language_id.L2)

    order = np.random.default_rng(3)
    for _ in range(2):
        for i in order.permutation(len(rows)):
            columns, x, y = rows[i]
            w = {(c, k): weight(c, k) for c in columns for k in range(3)}
            scores = [sum(v * w[c, k] for c, v in zip(columns, x, strict=True)) for k in range(3)]
            total = sum(np.exp(s) for s in scores)
            for c, v in zip(columns, x, strict=True):
                for k in range(3):
                    g = v * (np.exp(scores[k]) / total - (k == y))
                    step = ((n[c][k] + g * g) ** 0.5 - n[c][k] ** 0.5) / language_id.ALPHA
                    z[c][k] += g - step * w[c, k]
                    n[c][k] += g * g
    got = language_id.ftrl(rows, 3, epochs=2)
    assert np.allclose(got, [[weight(c, k) for k in range(3)] for c in range(12)])
    sparse, columns, x = language_id.Sparse(got), np.array([1, 4, 7]), np.array([0.5, 0.25, 2.0])
    assert np.allclose(sparse.dot(columns, x), x @ got[columns]) and np.allclose(sparse.dot(columns[:0], x[:0]), 0)
    scores, truth = rng.normal(size=(80, 3)) * 4, rng.integers(0, 3, 80)
    loss = lambda t: float(np.mean([np.log(np.exp(s / t).sum()) - s[y] / t for s, y in zip(scores, truth, strict=True)]))
    grid = [float(np.exp(a)) for a in np.linspace(-4, 3, 2001)]
    assert abs(loss(language_id.calibrate(scores, truth)) - min(map(loss, grid))) < 1e-4


def test_open_buckets_are_cut_by_size(spark):
    """Sets that may be linked still meet, others do not, and small shares of many hubs make few blocks."""
    sizes = [*range(1, 60), 100, 124, 125, 126, 4000, 5000, 5001]
    known = spark.createDataFrame([(7, k, k, n, k) for k, n in enumerate(sizes)], "h long, hub long, rep long, n long, comp long")
    cut = minhash_dedup._by_size(known, 80).collect()
    held = defaultdict(set)
    for r in cut:
        held[r.rep].add(r.h)
    assert len(cut) == 2 * len(sizes)
    for i, n in enumerate(sizes):
        for j, m in enumerate(sizes):
            assert held[i] & held[j] or 100 * min(n, m) < 80 * max(n, m)
            assert not held[i] & held[j] or 64 * max(n, m) < 100 * 100 / 64 * min(n, m)
    members = spark.createDataFrame([(k, k, 10, k % 3) for k in range(300)], "id long, hub long, n long, c long")
    assert minhash_dedup._blocked(members, Stage(spark, "test"), by_size=True).select("k").distinct().count() == 3


def test_windows_are_shuffled_without_being_written_first(spark, monkeypatch):
    from webgrain.llm import staging

    put, columns = staging.Stage.put, []
    monkeypatch.setattr(staging.Stage, "put", lambda self, df, name="t": (columns.append(set(df.columns)), put(self, df, name))[1])
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, f"{a} one"), (2, f"two {a} {b}"), (3, f"{b} three {a}"), (4, None), (5, f"{a} {b} {a}")]
    got = {r.doc_id: r.text for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()}
    assert got == {1: f"{a} one", 2: f"two {b}", 3: "three", 4: None, 5: ""}
    assert not any({"w1", "pos"} <= c for c in columns)


def test_tables_that_no_result_reads_are_removed(spark):
    import os

    from webgrain.llm.staging import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before, text = set(os.listdir(folder)), " ".join(f"w{i}" for i in range(60))
    out = minhash_dedup.near_duplicates(spark.createDataFrame([(1, text), (2, text + " x"), (2, text), (3, "y")], "doc_id long, text string"))
    (made,) = set(os.listdir(folder)) - before
    assert {t.split("-", 1)[1] for t in os.listdir(f"{folder}/{made}")} <= {"sketches", "named", "whole"}
    assert sorted((r.doc_id, r.component_id) for r in out.collect()) == [(1, 1), (2, 1), (2, 1), (3, 3)]
