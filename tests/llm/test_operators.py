"""The operators against brute force, exact round trips and odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalframe.llm import chat, common, exact_dedup, html_text, jaccard_join, language_model, mixing, sentencepiece, sharding, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = ["ka", "lo", "mi", "ré", "tu", "漢", "ß", "no"]


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]


def corpus(rng: random.Random) -> list[tuple]:
    """Texts with copies, near copies, a shared passage, and odd rows; one source has a third of them."""
    texts: list[str | None] = [" ".join(words(rng, rng.randint(1, 80))) for _ in range(60)]
    passage = " ".join(words(rng, 20))
    texts += [f"{t} {passage}" for t in texts[:20]]
    texts += [t.replace(" ", "\n ") + "\t" for t in texts[:15]]
    for t in texts[20:50]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", " \n\t", "one", "ONE", "a b c d", "a b c d e", "A  B c\vd", "x " * 3000]
    rows = [(i, t, "en", "src0" if i % 3 == 0 else f"src{i % 4}", 0) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[0], (None, "no id", None, None, None), (None, None, None, None, None), (5, "another text of a used id", "en", "src1", 0)]


@pytest.fixture(scope="module")
def rows():
    return corpus(random.Random(3))


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def normal(text: str | None) -> str:
    return "".join(c for c in text or "" if c not in " \t\n\v\f\r")


# sharding


def test_shards_are_a_balanced_permutation(docs, rows):
    clash = docs.withColumns({"shard": F.lit("x"), "SLOT": F.lit(1), "_bucket2": F.lit(2)})
    out = sharding.shuffle_into_shards(clash, 16, seed=1, bucket_bytes=4096)
    assert [c for c in out.columns if c.lower() in ("shard", "slot")] == ["shard", "slot"]
    got = [(r.shard, r.slot, r.doc_id, r.text) for r in out.collect()]
    sizes = Counter(s for s, *_ in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(slot for shard, slot, *_ in got if shard == s) == list(range(n))
    assert Counter((i, t) for *_, i, t in got) == Counter((r[0], r[1]) for r in rows)
    assert got and sorted(got, key=str) == sorted(((r.shard, r.slot, r.doc_id, r.text) for r in out.collect()), key=str)


def test_shards_depend_on_the_seed_and_survive_few_rows(docs, empty):
    a, b = ({(r.doc_id, r.text): r.shard for r in sharding.shuffle_into_shards(docs, 4, seed=s).collect()} for s in (1, 2))
    assert a != b
    assert sharding.shuffle_into_shards(empty).count() == 0
    assert sorted((r.shard, r.slot) for r in sharding.shuffle_into_shards(docs.limit(3).coalesce(1), 16).collect()) == [(0, 0), (1, 0), (2, 0)]


def test_bucket_offsets_over_many_runs(spark):
    counts = spark.range(3000).select(F.col("id").alias("b"), (F.col("id") % 5).alias("_rows"))
    got = {r.b: (r._offset, r._total) for r in sharding.bucket_offsets(counts, "b").collect()}
    total = 0
    for b in range(3000):
        assert got[b] == (total, 6000)
        total += b % 5


def test_written_shards_read_back(docs, tmp_path):
    out = sharding.write_shards(sharding.shuffle_into_shards(docs, 2), str(tmp_path / "s"))
    assert out.count() == docs.count() and {p.name for p in (tmp_path / "s").glob("shard=*")} == {"shard=0", "shard=1"}


# SentencePiece


@pytest.fixture(scope="module")
def vocab():
    return sentencepiece.load_vocabulary()


def best_score(unit: bytes, vocab) -> float:
    """Plain dynamic programming over all pieces."""
    by_bytes = {p: vocab.scores[i] for i, p in enumerate(vocab.pieces) if np.isfinite(vocab.scores[i])}
    text = unit.decode()
    best = [0.0] + [-math.inf] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - 48), end):
            piece = text[begin:end].encode()
            if piece in by_bytes:
                best[end] = max(best[end], best[begin] + by_bytes[piece])
        if text[end - 1].encode() not in by_bytes:
            best[end] = max(best[end], best[end - 1] + vocab.byte_score)
    return best[-1]


def test_segmentation_is_the_best_one(vocab, rows):
    units = sorted({" " + w for _, t, *_ in rows for w in (t or "").split()} | {"   ", " " + "ka" * 50, " 漢😀é", " \t\n"})[:300]
    ids, starts = sentencepiece.segment(pa.array([u.encode() for u in units], pa.binary()), vocab)
    for k, unit in enumerate(units):
        own = ids[starts[k] : starts[k + 1]]
        chars = [c for c in unit if c.encode() not in set(vocab.pieces[3 + 256 :])]
        score = sum(vocab.scores[i] for i in own if np.isfinite(vocab.scores[i])) + len(chars) * vocab.byte_score
        assert score == pytest.approx(best_score(unit.encode(), vocab)), unit
        assert sentencepiece.segment_one(unit.encode(), vocab) == own.tolist()


def test_same_pieces_as_the_public_implementation(vocab, rows):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece as public

    model = pb.ModelProto()
    with open(sentencepiece.MODEL_PATH, "rb") as f:
        model.ParseFromString(f.read())
    for i, piece in enumerate(model.pieces):
        if np.isfinite(vocab.scores[i]):
            piece.score, piece.type = float(vocab.scores[i]), 1
    model.trainer_spec.model_type = 1
    processor = public.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = [t for _, t, *_ in rows if t]
    same = sum(a == processor.encode(t) for a, t in zip(sentencepiece.encode_texts(pa.array(texts), vocab).to_pylist(), texts))
    assert same >= 0.95 * len(texts)  # the rest differ by ties in single precision


@pytest.mark.parametrize("text", ["", " ", "a", "  a  b ", "\n\t x", "漢字😀 é", "x▁y ▁", "ab" * 3000, " " * 100, "\x00\x7f", "é" * 200])
def test_round_trip_of_a_text(vocab, text):
    ids = sentencepiece.encode_texts(pa.array([text]), vocab)
    assert sentencepiece.decode_ids(ids, vocab).to_pylist() == [text]
    assert (len(ids.values) == 0) == (text == "")


def test_round_trip_of_a_table(docs, empty, vocab):
    out = sentencepiece.round_trip(docs.withColumn("token_ids", F.lit("replaced")), vocab)
    assert out.where("not exact").count() == 0 and out.count() == docs.count()
    assert out.where("text is null").select(F.max(F.size("token_ids"))).first()[0] == 0
    assert sentencepiece.round_trip(empty, vocab).count() == 0


def test_odd_ids_decode(vocab):
    ids = pa.array([[0, 1, 2, 10**9, -5], None, [vocab.byte_ids[0xE6]], []], pa.list_(pa.int32()))
    assert sentencepiece.decode_ids(ids, vocab).to_pylist() == ["", "", "�", ""]


def test_double_array_holds_exactly_its_keys():
    keys = {bytes(random.Random(k).choices(range(256), k=k % 7 + 1)): k for k in range(2000)}
    base, check, value = sentencepiece.double_array(keys)
    for key, k in keys.items():
        state = 0
        for c in key:
            assert check[base[state] + c] == state
            state = base[state] + c
        assert value[state] == k
    assert (value >= 0).sum() == len(keys)


# exact duplicates


def expected_labels(rows):
    groups: dict[str, list] = {}
    for i, t, *_ in rows:
        groups.setdefault(normal(t), []).append((-len(t or ""), (i is not None, i or 0), i))
    return {key: (min(g)[2], len(g)) for key, g in groups.items()}


def test_labels_of_copies(docs, rows, empty):
    got = exact_dedup.label_copies(docs).collect()
    want = expected_labels(rows)
    texts = {hashlib.sha256(key.encode()).hexdigest(): key for key in want}
    assert len(got) == len(rows)
    for r in got:
        assert (r.keep_id, r.group_size) == want[texts[r.text_sha256]]
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept) == set(texts) and set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.label_copies(empty).count() == 0


def test_one_row_of_each_group_stays(docs, rows, empty):
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(normal(t) for _, t in got) == sorted({normal(t) for _, t, *_ in rows})
    want = expected_labels(rows)
    assert all(want[normal(t)][0] == i for i, t in got)
    assert exact_dedup.drop_copies(empty).count() == 0


def test_an_id_with_white_space_variants_keeps_one(spark):
    texts = [(1, "a b c d"), (1, "ab cd"), (1, "a bcd "), (2, "abcd"), (1, "another text"), (3, "x  y"), (3, "x y"), (3, "x  y")]
    got = exact_dedup.drop_copies(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "a b c d"), (1, "another text"), (3, "x  y")]


def test_chunks_make_up_the_text(spark):
    text = "".join(random.Random(1).choices("abc.!漢", weights=[9, 9, 9, 1, 1, 2], k=20_000)) + "z" * 5000
    parts = spark.createDataFrame([(text,), ("",)], "t string").select(exact_dedup.chunks(F.col("t")).alias("c")).collect()
    assert "".join(parts[0].c) == text and parts[1].c == []
    assert max(map(len, parts[0].c)) <= exact_dedup.CHUNK_MIN + exact_dedup.CHUNK_MORE + 1
    shifted = spark.createDataFrame([("q" * 37 + text,)], "t string").select(exact_dedup.chunks(F.col("t")).alias("c")).first().c
    assert len(set(shifted) & set(parts[0].c)) > 0.5 * len(shifted)


def test_chunks_that_share_a_hash_are_told_apart(spark):
    parts = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "c")], "hash long, chunk string")
    assert sorted(tuple(r) for r in exact_dedup.shared_identifiers(parts).collect()) == [(1, 0, "a"), (1, 1, "b")]


# mixing


def test_pfair_deviates_by_less_than_a_block():
    rng = random.Random(5)
    for _ in range(60):
        parts = {f"s{i}": rng.randint(1, 30) for i in range(rng.randint(1, 9))}
        total, done = sum(parts.values()), Counter()
        for t, name in enumerate(mixing.pfair_period(parts), 1):
            done[name] += 1
            assert all(abs(Fraction(parts[s] * t, total) - done[s]) < 1 for s in parts)
        assert done == parts


def test_mixture_keeps_all_rows_and_the_weights(spark):
    rows = [(i, None if i % 10 == 9 else "big" if i % 3 else "small", i) for i in range(1000)] + [(7, "big", 0), (7, "big", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot long")
    weights = {"big": 3, "small": 2}
    mixed = mixing.mix(df, weights, block_rows=8).collect()
    assert Counter((r.doc_id, r.source) for r in mixed) == Counter((i, s) for i, s, _ in rows)
    blocks = sorted({(r.slot, r.source, r.phase) for r in mixed})
    assert [s for s, *_ in blocks] == list(range(len(blocks)))
    assert Counter((r.slot, r.row_in_block) for r in mixed).most_common(1)[0][1] == 1
    done = Counter()
    for t, (_, source, phase) in enumerate(blocks, 1):
        if phase == 0:
            done[source] += 1
            assert all(abs(Fraction(w * t, 6) - done[s]) < 1 for s, w in (("big", 3), ("small", 2), (None, 1)))
    assert len({p for *_, p in blocks}) == 3


def test_mixture_splits_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 50)
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 900, "hot").otherwise("cold").alias("source"))
    rows, sizes = mixing.number_in_source(df, "source", "doc_id", 0)
    got = sorted((r._source, r._n) for r in rows.collect())
    assert got == [("cold", i) for i in range(100)] + [("hot", i) for i in range(900)]
    assert {r._source: r.n for r in sizes.collect()} == {"hot": 900, "cold": 100}


def test_mixture_of_nothing_and_bad_weights(empty, docs):
    assert mixing.mix(empty, {}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"src0": 0})


# top-k


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(topk, "SHARDS_PER_TASK", 2)
    monkeypatch.setattr(topk, "QUERY_ROWS", 10)
    monkeypatch.setattr(topk, "LEAF_ROWS", 8)
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(900, 6)).round(2).tolist()
    vectors[100:400] = [vectors[0]] * 300  # ties
    rows = [(i, v) for i, v in enumerate(vectors)]
    odd = [(2000, None), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2040, [float("nan")] * 6), (2060, [float("inf")] * 6), (2080, [1.0, 2.0]), (2100, []), (None, [1.0] * 6), (20, vectors[1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    known = [(i, [math.floor(64 * x) for x in v]) for i, v in [*rows, (20, vectors[1])]]
    for i, q in known[:900:20]:
        if i != 20:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in known if j != i)[:5]
            assert sorted(got[i]) == [(k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert len(got[20]) == 10 and not {2000, 2020, 2040, 2060, 2080, 2100} & set(got)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_top_k_of_large_components():
    a, b = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0], [2.0**40, 0.0]])
    assert topk.products(a, b).tolist() == [[2**60 + 3, topk.LARGEST]]


# toxicity


def test_folding():
    assert toxicity.fold("Idi0t, ＩＤＩОT-") == " idiot idiot "
    assert toxicity.fold("s­cum") == " scum " and toxicity.fold("") == "  "


def test_exception_phrases_excuse():
    machine = toxicity.Lexicon({" trash": 2.0, " trash ": 3.0}, [" trash can "]).automaton()
    assert toxicity.measure("the trash can", machine) == (0.0, 3)
    assert toxicity.measure("you trash, trashy trash can", machine) == (5.0, 5)
    assert toxicity.measure(None, toxicity.Lexicon().automaton()) == (0, 1)


def test_learned_lexicon_finds_planted_words(spark, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        w, toxic = words(rng, rng.randint(20, 200)), int(i % 6 == 0)
        if toxic:
            for _ in range(3 + len(w) // 40):
                w[rng.randrange(len(w))] = rng.choice(["vilest", "vil3st", "grubberix", "grubberon", "GRUBBERA"])
        rows.append((i, " ".join(w), None, None, None))
        labels.append((i, toxic))
    docs = spark.createDataFrame([*rows, (9000, None, None, None, None), (9001, "", None, None, None)], DOCS)
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn_by_fold(docs, known)
    out = {r.doc_id: r for r in toxicity.score(docs.withColumn("score", F.lit("x")), lexicon).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out[i].predicted == y for i, y in held) >= 0.98 * len(held)
    assert out[9000].predicted == out[9001].predicted == 0 and all(0 <= r.score <= 1 for r in out.values())
    nothing = toxicity.learn_by_fold(docs, known.limit(0))
    assert nothing.terms == {} and toxicity.score(empty, nothing).count() == 0


# n-gram Jaccard join


def shingles(text: str | None) -> set:
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected_components(rows):
    rows = [r for r in rows if r[0] is not None]
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                root = [root[b] if r == root[a] else r for r in root]
    least = {}
    for (i, *_), r in zip(rows, root):
        least[r] = min(least.get(r, i), i)
    return sorted((r[0], len(s), least[x]) for r, s, x in zip(rows, sets, root))


def test_components_against_brute_force(docs, rows, empty):
    got = sorted(tuple(r) for r in jaccard_join.components(docs).collect() if r.doc_id is not None)
    assert got == expected_components(rows)
    assert jaccard_join.components(docs).count() == len(rows)
    assert jaccard_join.components(empty).count() == 0


def test_components_in_tiles_with_hubs_and_hot_shingles(spark, monkeypatch, tmp_path):
    rng = random.Random(9)
    base, other = words(rng, 60), words(rng, 60)
    rows = []
    for i in range(150):  # a chain of ever more changes, so that not all sets link with the hub
        w = list(base if i % 3 else other)
        for k in range(i % 40 // 8):
            w[12 * k % 60] = f"new{i % 40}{k}"
        rows.append((i, " ".join(w), None, None, None))
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, DOCS).write.parquet(path)
    monkeypatch.setattr(jaccard_join, "TILE_SHINGLES", 500)
    monkeypatch.setattr(jaccard_join, "HOT", 2)
    assert sorted(tuple(r) for r in jaccard_join.components(spark.read.parquet(path)).collect()) == expected_components(rows)


def test_one_of_each_keeps_unlinked_rows(docs, rows):
    got = Counter(r.doc_id for r in jaccard_join.one_of_each(docs).collect() if r.doc_id is not None)
    drop = {i for i, _, c in expected_components(rows) if i != c}
    assert got == Counter(r[0] for r in rows if r[0] is not None and r[0] not in drop)


def test_one_of_each_tells_texts_of_one_id_apart(spark):
    text, other, third = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    near = [f"{t} more" for t in (text, other, third)]
    texts = [(1, text), (2, near[0]), (2, other), (3, third), (3, near[2]), (4, near[2]), (4, ""), (4, None)]
    got = jaccard_join.one_of_each(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    rest = [(r.doc_id, r.text) for r in got if r.doc_id != 3]
    assert sorted(rest, key=str) == sorted([(1, text), (2, other), (4, ""), (4, None)], key=str)
    assert [r.text in (third, near[2]) for r in got if r.doc_id == 3] == [True]


def test_bound_never_undercuts_the_overlap():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, 100)) for _ in range(20)]
    points = jaccard_join.group_counts(sets, 16)
    for a in range(20):
        for b in range(20):
            assert np.minimum(points[a], points[b]).sum() >= len(np.intersect1d(sets[a], sets[b]))


def test_connected_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(1000, 1001)], "a long, b long"))
    got = {r.node: r.component for r in common.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}
    assert common.connected_components(edges.limit(0)).count() == 0


def test_connected_components_of_edges_that_turn_when_computed_again(spark):
    def turned(batches):
        for batch in batches:
            flip = np.random.default_rng().random(batch.num_rows) < 0.5
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_pydict({"a": np.where(flip, a, b), "b": np.where(flip, b, a)})

    edges = spark.range(0, 200, 2).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).mapInArrow(turned, "a long, b long")
    got = {r.node: r.component for r in common.connected_components(edges).collect()}
    assert got == {n: n // 2 * 2 for n in range(200)}


def test_links_do_not_depend_on_the_order_of_rows():
    rng = np.random.default_rng(5)
    base = np.arange(200)
    sets = [np.sort(rng.choice(base, 150 + k % 40, replace=False)) for k in range(60)]
    size = np.array([len(s) for s in sets])
    table = pa.table({"node": np.arange(60) * 7, "n": size, "keys": sets, "linked": np.arange(60) < 5})
    found = [jaccard_join.linker(75)(table.take(rng.permutation(60))) for _ in range(4)]
    assert all(f == found[0] for f in found) and len(found[0])


def test_a_bucket_is_permuted_alike_in_whatever_order_its_rows_arrive():
    table = pa.table({"id": range(50), "_place": range(100, 150), "_bucket": [1] * 50, "_offset": [7] * 50, "_total": [90] * 50})
    shuffle = sharding.bucket_shuffler(4, 3, ["id"])
    found = [shuffle(table.take(np.random.default_rng(k).permutation(50))) for k in range(3)]
    assert all(f == found[0] for f in found) and found[0]["id"].to_pylist() != list(range(50))


# language model


def test_counts_and_base_scores(docs, rows):
    got = language_model.score_texts(docs).collect()
    tokens = [(i, (t or "").encode().lower().split() + [b" "]) for i, t, *_ in rows]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    base = lambda ws: sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
    key = lambda i, *rest: (i is not None, i or 0, *rest)
    want = sorted(key(i, len(ws), sum(count[w] > 0 for w in ws), round(base(ws), 6)) for i, ws in tokens)
    assert sorted(key(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.held_out == held(r.doc_id) for r in got)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_totals_beyond_32_bits():
    key, n = np.array([7], np.uint64).tobytes(), np.array([3_000_000_000], np.uint32).tobytes()
    sent = {"chunk": [0, 1, 2], "kind": [0] * 3, "bucket": [0] * 3, "deleted": [True, False, False], "keys": [key] * 3, "n": [n] * 3}
    out = language_model.totals(pa.table(sent))
    assert [np.frombuffer(b, np.int64).tolist() for b in out["total"].to_pylist()] == [[9_000_000_000]] * 3
    assert np.frombuffer(out["kept"].to_pylist()[0], np.int64).tolist() == [6_000_000_000]


def test_model_is_a_distribution_and_beats_the_base(spark, tmp_path, empty):
    rng = random.Random(1)
    follow = {w: rng.sample("abcdefgh", 2) for w in "abcdefgh"}

    def text() -> str:
        w = [rng.choice("abcdefgh")]
        for _ in range(60):
            w.append(rng.choice(follow[w[-1]]) if rng.random() < 0.9 else rng.choice("abcdefgh"))
        return " ".join(w)

    path = str(tmp_path / "d")
    spark.createDataFrame([(i, text(), None, None, None) for i in range(400)], DOCS).write.parquet(path)
    held = [r for r in language_model.score_texts(spark.read.parquet(path)).collect() if r.held_out]
    assert len(held) > 20 and all(r.score > r.base_score for r in held)
    assert language_model.score_texts(empty).count() == 0
    weights = language_model.learn_weights([(3, 20, 4, 100), (3, -1000, 4, 10), (5, 30, 2, 50)])
    assert np.allclose(weights.sum(axis=1), 1) and (weights[:, 2] > 0).all() and weights[0, 0] == 0
    assert weights[3, 0] > weights[3, 1]


def test_learned_weights_raise_the_likelihood():
    cells = [(2, 12, 3, 40), (2, -1000, 6, 25), (2, -1000, -1000, 5), (2, 4, 8, 30)]
    weights = language_model.learn_weights(cells)[2]
    likelihood = lambda w: sum(n * math.log(w[0] * (a > -1000) * 2 ** (a / 4) + w[1] * (b > -1000) * 2 ** (b / 4) + w[2]) for _, a, b, n in cells)
    assert all(likelihood(weights) >= likelihood(np.random.default_rng(s).dirichlet(np.ones(3))) - 1e-6 for s in range(200))


# chat


def call(identifier, name="ask", **arguments):
    import json

    return {"id": identifier, "name": name, "arguments": arguments} if identifier else json.dumps(arguments)


def test_tool_calls_are_linked_ordered_and_validated(spark):
    import json

    calls = [call("a", text="x", turn=-1, after=["b"]), call("b", name="zzz", z=1, a={"d": 1.5, "c": "é\n"}), call("c", text="q", turn=2, after=["a", "b", "gone"])]
    rows = [
        (1, 0, "assistant", json.dumps({"tool_calls": calls})),
        (1, 1, "tool", '{"tool_call_id":"a","content":"one"}'), (1, 2, "tool", '{"tool_call_id":"a","content":"two"}'),
        (1, 3, "tool", '{"tool_call_id":"q","content":"x"}'), (1, 4, "user", None), (None, 0, "user", 'hi "x"'),
        (2, 0, "tool", '{"tool_call_id":"a","content":"early"}'),
        (2, 1, "assistant", json.dumps({"tool_calls": [call("a", turn=1, after=["b"]), call("b", text="x", turn=1, after=["a"]), {"id": None, "name": "ask", "arguments": "no"}]})),
        (2, 2, "assistant", json.dumps({"tool_calls": [call("a", text="again", turn=2)]})), (2, 3, "assistant", "{not json"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("call_id", F.lit("clash"))
    got = {(r.conv_id, r.turn, r.item): r for r in chat.link_tool_calls(df, chat.ASK).collect()}
    assert len(got) == 14
    status = {k: (r.kind, r.status, r.level, r.other_turn) for k, r in got.items()}
    assert status[1, 0, 0] == ("call", "answered", 2, 1) and status[1, 0, 1] == ("call", "open", 0, None) and status[1, 0, 2] == ("call", "open", 4, None)
    assert status[1, 1, 0] == ("result", "linked", 3, 0) and status[1, 2, 0][:2] == ("result", "repeated") and status[1, 3, 0] == ("result", "orphan", None, None)
    assert status[2, 0, 0][:2] == ("result", "early") and status[2, 2, 0][:2] == ("call", "repeated") and status[2, 1, 2][:2] == ("call", "unnamed")
    assert status[2, 1, 1][2] is None and status[2, 3, 0][:2] == ("message", "message")
    assert got[1, 0, 0].errors == ["turn: too small"] and got[1, 0, 1].errors == ["name: unknown tool"] and got[2, 1, 0].errors == ["text: missing"]
    assert got[1, 0, 1].json == '{"arguments":{"a":{"c":"é\\n","d":1.5},"z":1},"id":"b","kind":"call","name":"zzz","status":"open","turn":0}'
    assert all(json.loads(r.json) for r in got.values())
    assert chat.link_tool_calls(df.limit(0), chat.ASK).count() == 0


def test_depth_of_a_long_chain_and_a_cycle(spark):
    nodes = spark.range(200).select(F.col("id").cast("string").alias("node"))
    edges = spark.range(1, 150).select(F.col("id").cast("string").alias("node"), (F.col("id") - 1).cast("string").alias("parent"))
    edges = edges.union(spark.createDataFrame([("160", "161"), ("161", "160"), ("162", "161")], "node string, parent string"))
    got = {int(r.node): r.depth for r in chat.depths(nodes, edges, F.lit(0)).collect()}
    assert [got[i] for i in range(150)] == list(range(150)) and got[155] == 0 and got[160] is got[161] is got[162] is None


# HTML


def test_article_text():
    page = (
        '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>menu</a></li></ul></nav>'
        '<div class="ad">buy</div><article><h1>A &amp; B</h1><p><b>one  two<br>three<p>four &#233;&nbsp;x</p><aside>no</aside><form>no</form>'
        '<ul><li>item 1<li>item 2</ul><p>last</p><section class="comments"><p>me too</p></section></article><footer>&copy; foot</footer></body></html>'
    )
    assert html_text.main_text(page) == "A & B\n\none two three\n\nfour é x\n\nitem 1\n\nitem 2\n\nlast"


def test_page_without_marks_uses_the_ratios():
    text = "word " * 60
    menu = "".join(f"<a href=/{i}>m{i}</a> " for i in range(40))
    page = f"<body><div>{menu}</div><div><p>{text}</p><p>{text}</p><p>{text}</p></div><div>{menu}</div>"
    assert html_text.main_text(page) == "\n\n".join([text.strip()] * 3)


def test_no_line_of_the_regions_is_lost():
    text = "word " * 60
    menu = "<nav>" + "<a href=/>m</a> " * 9 + "</nav>" + "".join(f"<p><a href=/{i}>m{i}</a></p>" for i in range(20))
    short = f"<p>{text}</p>"
    long = short * 40
    lead = f"<body><div>{menu}</div><div><p>lead {text * 4}</p><div>{long}</div></div><div>{menu}</div>"
    assert "lead word" in html_text.main_text(lead)
    sections = f"<body><div>{menu}</div><div><section>{long}</section><section>{short}<p>end {text}</p></section></div>"
    assert "end word" in html_text.main_text(sections) and "m3" not in html_text.main_text(sections)
    cards = "".join(f"<article><p>card {i} {text * 3}</p></article>" for i in range(3))
    page = html_text.main_text(f"<body><main><div><p>first {text}</p>{short * 9}</div></main><div>{menu}</div><div>{cards}</div>")
    assert page.startswith("first word") and all(f"card {i}" in page for i in range(3))
    assert [html_text.main_text(f"<body>{menu}{cards}").count(f"card {i}") for i in range(3)] == [1, 1, 1]


@pytest.mark.parametrize("start", ["<body><p>", "<p>", "<b>", "", "<body><main><div>"])
def test_a_head_without_its_end_tag(start):
    assert html_text.main_text(f"<html><head><meta charset=utf-8><title>t</title><style>p{{}}</style>\n{start}some text") == "some text"


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("plain &lt;", "plain <"), ("<![foo[ x ]]> hello <p>", "<![foo[ x ]]> hello"), ("<p>", ""), ("</div></p>a", "a")])
def test_odd_pages(html, text):
    assert html_text.main_text(html) == text


def test_pages_as_a_table(spark):
    df = spark.createDataFrame([(1, "<p>é漢</p>"), (2, None), (2, None)], "page_id long, html string").withColumn("n_chars", F.lit("x"))
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()) == [(1, "é漢", 2), (2, "", 0), (2, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0
    long = "<article>" + "<p>" + "x" * 6_000_000 + "</p></article>"
    assert html_text.extract(spark.createDataFrame([(long,)], "html string")).first().n_chars == 6_000_000


# words


def test_words_against_plain_python(rows):
    texts = [r[1] for r in rows]
    found, counts = common.words_of(pa.array(texts, pa.string()))
    want = [(t or "").encode().lower().split() for t in texts]
    assert counts.tolist() == [len(w) for w in want] and found.to_pylist() == [w for ws in want for w in ws]
