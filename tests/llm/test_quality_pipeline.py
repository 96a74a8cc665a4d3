"""Held-out accuracy of the classifier; the pipeline end to end."""

import collections
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_joins_and_suffixes import _lines, _shingles
from tokenizers import Tokenizer

import corpus_pipeline
from parimart.llm import mixing, packing, quality, queries
from parimart.llm.words import Words, utf8

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = queries.op5_score_quality(spark, SF)
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_linear_time_score_is_the_sum_over_pairs():
    m = quality.FactorisationMachine()
    r = np.random.default_rng(0)
    m.w = r.normal(size=m.w.shape).astype(np.float32)
    row, index, value = np.array([0, 0, 0, 1]), np.array([3, 9, 40, 7]), np.array([0.5, 1, 2, 1], np.float32)
    z = m.w[[3, 9, 40]] @ value[:3] + sum(m.v[i] @ m.v[j] * x * y for a, (i, x) in enumerate(zip(index[:3], value[:3])) for j, y in list(zip(index[:3], value[:3]))[a + 1 :])
    assert abs(m.score(row, index, value, 2)[0] - 1 / (1 + np.exp(-z))) < 1e-5


def test_scores_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (2, ""), (3, "w " * 200_000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.score_quality(df, quality.train(df, labels)).collect()
    assert len(out) == 5 and all(r.predicted == 1 for r in out)
    model = quality.train(df, spark.createDataFrame([(1, 1), (3, 0), (3, None), (None, 1)], "doc_id long, quality int"))
    assert quality.score_quality(df.limit(0), model).isEmpty()


def _plain_score(m, text):
    """The score of a text by loops over its words, statistics and all pairs of features."""
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    hashed = [int(Words(np.frombuffer(w, np.uint8), np.array([0, len(w)])).hash[0]) & ((1 << quality.BITS) - 1) for w in words]
    n, size = max(1, len(words)), max(1, len(raw))
    symbol = lambda b: 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in "!,.:;?"
    share = lambda kind: sum(map(kind, raw)) / size
    per_word = lambda kind: sum(map(kind, words)) / n
    x = {h: math.sqrt(hashed.count(h) / n) for h in set(hashed)}
    statistics = [
        share(lambda b: 65 <= b < 91), share(lambda b: 48 <= b < 58), share(lambda b: chr(b) in "!,.:;?"), share(symbol), share(lambda b: b > 127),
        share(lambda b: b in b" \t\n\x0b\x0c\r"), len(set(hashed)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, per_word(lambda w: symbol(w[-1])),
        per_word(lambda w: w[-1] == 33), per_word(lambda w: len(w) == 1 and symbol(w[0])), per_word(lambda w: len(w) > 20), math.log1p(len(words)) / 8,
        min(sum(map(len, words)) / n / 10, 2), math.log1p(len(raw) / (raw.count(10) + 1)) / 8, 1.0,
    ]
    x |= {(1 << quality.BITS) + k: v for k, v in enumerate(statistics)}
    z = m.bias + sum(m.w[i] * v for i, v in x.items())
    z += sum(float(m.v[i] @ m.v[j]) * x[i] * x[j] for i, j in itertools.combinations(x, 2))
    return 1 / (1 + math.exp(-z))


def test_whole_rows_match_a_plain_scorer(spark):
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(40).collect()
    texts = [r.text for r in rows if r.text is None or len(r.text) < 3000] + [None, "", "a", "!!! $ $ $", "Ä Ö ü\n\nA A A", "\x0b x" * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in quality.score_quality(df, model).collect():
        assert abs(x.score - _plain_score(model, texts[x.doc_id])) < 1e-4


def test_repeated_and_text_ids(spark):
    texts = ["good words here and there", "bad $$ !! words"]
    labels = [("a", 1), ("b", 0), ("c", 1), ("d", 0), ("e", 1), ("f", 0)]
    rows = [(i, texts[1 - y]) for i, y in labels] + [("a", "later text")] * 500
    df = spark.createDataFrame(rows, "doc_id string, text string")
    marks = spark.createDataFrame(labels, "doc_id string, quality int")
    many, one = quality.train(df, marks), quality.train(df.dropDuplicates(["doc_id", "text"]), marks)
    assert many.bias == one.bias and np.array_equal(many.w, one.w)
    assert quality.score_quality(df, many).count() == len(rows)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.staged(stage(spark, docs, SF), "stage")
        assert docs.columns == before.columns, name
        assert docs.count() > 0.7 * before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == docs.count()


def test_stages_on_odd_rows(spark):
    rows = [(1, None, None, "a", 0), (2, "", "en", None, 0), (3, "x y z", "en", "a", 5), (3, "x y z", "en", "a", 5), (None, "p q r s t u", "en", "b", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n", F.lit(1))
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            assert out.columns == table.columns or name == "best-fit packing"
            out.count()


def test_mix_counts_rows_without_id_on_their_own(spark):
    rows = [(None if i % 3 else 5, "w " * (1 + i % 7), s) for s, n in (("a", 60), ("b", 600), ("c", 90)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.source: r.n for r in corpus_pipeline.mix(spark, docs, SF).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    copies = mixing.mix_sources(docs).groupBy("source_size").agg(F.sum("copies").alias("n")).collect()
    assert sorted(got.values()) == sorted(r.n for r in copies)


def _linear_score(m, text):
    data, offsets = utf8(pa.array([text or ""]))
    row, index, value = quality.features(data, offsets)
    z = m.bias + float(m.w[index] @ value)
    for f in range(quality.RANK):
        v = m.v[index, f] * value
        z += 0.5 * float(v.sum() ** 2 - (v * v).sum())
    return 1 / (1 + math.exp(-z))


def test_every_stage_matches_plain_code(spark, tmp_path):
    """Each stage's rows from plain code on what the stage before it kept; the columns of documents may clash with the stages' own."""
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 6000")
    docs = small.withColumns({"_row": F.lit("x"), "size": F.lit(1), "score": F.lit("s"), "n_removed": F.lit(0)})
    before = docs.collect()
    columns = docs.columns

    def run(k, rows):
        return corpus_pipeline.staged(corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame(rows, docs.schema), SF), "stage")

    # Quality classifier
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = run(0, before).collect()
    scores = [(_linear_score(model, r.text), r) for r in before]
    assert sorted(str(r) for r in kept) == sorted(str(r) for x, r in scores if x >= quality.CUT) and 0 < len(kept) < len(before)
    # Line dedup
    cut = run(1, kept)
    assert cut.columns == columns
    want = {i: t for i, (_, t) in _lines([(r.doc_id, r.text) for r in kept], least=1).items()}
    lines = cut.collect()
    ink = re.compile(r"[^\x20\x09-\x0D]")
    old = {r.doc_id: r.text for r in kept}
    assert {r.doc_id: r.text for r in lines} == {i: t for i, t in want.items() if t == old[i] or ink.search(t)}
    assert all(r.n_chars == len(r.text) for r in lines if r.text != old[r.doc_id])
    # N-gram Jaccard join: five words, 0.8; the lines' matches went before, so copies are added
    lines += [Row(**r.asDict() | {"doc_id": r.doc_id + 10**6, "text": f"{r.text} end"}) for r in lines if len(r.text.split()) > 40][:25]
    sets = {r.doc_id: _shingles(r.text, 5) for r in lines}
    near = {i: i for i in sets}

    def root(i):
        while near[i] != i:
            i = near[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 5 * both >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            near[y] = x
    single = run(2, lines).collect()
    assert sorted(r.doc_id for r in single) == sorted(i for i in sets if root(i) == i) and len(single) < len(lines)
    # Mixing
    spark.createDataFrame(single, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    copies = {r[0]: r[1] for r in con.execute(f"select doc_id, copies from ({queries.ORACLE_SQL['op2_mix_sources']})").fetchall()}
    mixed = run(3, single).collect()
    assert collections.Counter(r.doc_id for r in mixed) == collections.Counter({i: n for i, n in copies.items() if n})
    # Best-fit packing
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    pieces = run(4, mixed).collect()
    lengths = collections.Counter()
    for r in mixed:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            lengths[r.doc_id, k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in pieces) == lengths
    full = collections.defaultdict(list)
    for x in pieces:
        full[x.sequence_id].append((x.offset, x.length))
    for parts in full.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(full) <= 1.1 * sum(x.length for x in pieces) / 2048 + 1
