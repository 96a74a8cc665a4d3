"""Similarity joins, line dedup, suffix arrays and packing against brute force."""

import collections
import hashlib
import random
import tracemalloc
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parimart.llm import line_dedup, ngram_join, packing, queries, suffixes, words
from parimart.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def _components(rows, k, num, den):
    sets = [_shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and den * both >= num * (len(a) + len(b) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return {key: (len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(rows)}


def _variants(seed):
    r = random.Random(seed)
    texts = []
    for n in (3, 5, 6, 9, 14, 30, 90, 260):
        w = [f"w{r.randrange(60)}" for _ in range(n)]
        texts += [" ".join(w), " ".join(w).upper(), " ".join(w[:-1]), " ".join(["x", *w])]
        for p in (0.01, 0.03, 0.05):
            v = list(w)
            for _ in range(max(1, int(p * n))):
                v[r.randrange(n)] = f"z{r.randrange(999)}"
            texts.append(" ".join(v))
    return texts + [None, "", " \t\n", "one", "One", "é ü", "É ü"]


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 4, 5)])
def test_jaccard_components(spark, k, num, den):
    rows = list(enumerate(_variants(k)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("cls", F.lit("c"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, k=k, similarity=(num, den)).collect()}
    assert got == _components(rows, k, num, den)


def test_jaccard_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (9, "A b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.jaccard_components(df).collect()), key=str)
    assert got == [(7, 7), (7, 7), (9, 7), (None, 7)]
    assert ngram_join.jaccard_components(df.limit(0)).isEmpty()


def test_jaccard_links_through_a_row_without_id(spark):
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(w[:50])), (None, " ".join(w[4:54])), (3, " ".join(w[8:58])), (None, "alone a b c d e f")]
    assert _components(list(enumerate(t for _, t in rows)), 5, 4, 5)[2][1] == 0 and _components([(0, rows[0][1]), (1, rows[2][1])], 5, 4, 5)[1][1] == 1
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == [(1, 1), (3, 1), (None, 1), (None, None)]


def test_r_tree_finds_all_that_may_link():
    r = np.random.default_rng(3)
    base = r.poisson(3, (20, 16))
    points = np.concatenate([base + r.integers(0, 2, base.shape) for _ in range(40)]).astype(np.int32)
    sizes, labels = points.sum(axis=1), r.integers(0, 5, len(points))
    tree = ngram_join.RTree(sizes, points, labels)
    for q in range(0, len(points), 17):
        bound = np.minimum(points, points[q]).sum(axis=1)
        ok = (185 * bound >= 85 * (sizes + sizes[q])) & (labels != labels[q]) & (85 * np.maximum(sizes, sizes[q]) <= 100 * np.minimum(sizes, sizes[q]))
        assert sorted(tree.search(sizes[q], points[q], labels[q], 85, 100)) == np.flatnonzero(ok).tolist()


@pytest.mark.parametrize("num,den", [(85, 100), (4, 5), (1, 2), (3, 5)])
def test_linked_sets_share_a_key_and_others_none(num, den):
    r = np.random.default_rng(8)
    met = collections.Counter()
    for n in [*range(6, 30)] * 60:
        a = np.unique(r.integers(0, 1 << 64, n, np.uint64))
        keys = set(ngram_join.group_keys(a, num, den).tolist())
        met.update(keys)
        changes = int(r.integers(0, ngram_join.differ(n, num, den) + 1))
        b = np.unique(np.concatenate([r.permutation(a)[: n - int(r.integers(0, changes + 1))], r.integers(0, 1 << 64, changes, np.uint64)]))
        both = len(np.intersect1d(a, b))
        if den * both >= num * (len(a) + len(b) - both) and not np.array_equal(a, b):
            assert keys & set(ngram_join.group_keys(b, num, den).tolist())
    for n in range(6, 12):  # few shingles, of which many lie in one group
        a = np.sort(r.integers(0, 1 << 60, n, np.uint64))
        assert len(ngram_join.group_keys(a, num, den))
        if ngram_join.differ(n, num, den):
            for gone in range(n):
                b = np.delete(a, gone)
                if den * (n - 1) >= num * n:
                    assert set(ngram_join.group_keys(a, num, den).tolist()) & set(ngram_join.group_keys(b, num, den).tolist())
    assert max(met.values()) == 1


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 4, 5)])
def test_components_of_short_texts_and_repeated_ids(spark, k, num, den):
    r = random.Random(k)
    texts = []
    for i in range(60):
        w = [f"w{r.randrange(3000)}" for _ in range(r.randrange(9, 16))]
        texts += [" ".join(w), " ".join(w[:-1]), " ".join([*w, f"z{i}"])]
    rows = [(r.choice([7, None, *range(100, 400)]), t) for t in texts] + [(7, f"same id {i} other text of a few words {i * i} more {i} end") for i in range(150)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=k, similarity=(num, den)).collect()
    sets = [_shingles(t, k) for _, t in rows]
    nodes = list(range(len(rows)))

    def root(i):
        while nodes[i] != i:
            i = nodes[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            linked = both and den * both >= num * len(sets[i] | sets[j])
            if linked:
                nodes[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min([x for x in (d, least.get(root(i))) if x is not None], default=None)
    want = sorted(str((d, len(sets[i]), least[root(i)])) for i, (d, _) in enumerate(rows))
    assert sorted(str(tuple(x)) for x in got) == want


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i // 20 * 20 for i in range(60)}


def _lines(rows, num=4, den=5, least=5):
    spots = [(i is None, i or 0, i, k, frozenset(x.encode().split())) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    spots = sorted((s for s in spots if len(s[4]) >= least), key=lambda s: (s[0], s[1], s[3]))
    gone, seen = {}, []
    for _, _, i, k, s in spots:
        if any(den * len(s & u) >= num * len(s | u) for u in seen):
            gone.setdefault(i, set()).add(k)
        seen.append(s)
    return {i: (len(gone.get(i, ())), None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ()))) for i, t in rows}


@pytest.mark.parametrize(
    "partners,common,held,full,heads,pairs",
    [(16, 20_000, 1_000_000, 1 << 15, 32, 1 << 20), (1, 2, 50, 1 << 15, 32, 64), (1, 20_000, 50, 4, 1, 64), (1, 5, 50, 2, 1, 8)],
)
def test_line_dedup(spark, monkeypatch, partners, common, held, full, heads, pairs):
    for name, value in (("FULL", full), ("HEADS", heads), ("PAIRS", pairs)):
        monkeypatch.setattr(line_dedup, name, value)
    monkeypatch.setattr(line_dedup, "PARTNERS", partners)
    monkeypatch.setattr(line_dedup, "COMMON", common)
    monkeypatch.setattr(line_dedup, "HELD", held)
    monkeypatch.setattr(line_dedup, "BUCKET", held)
    r = random.Random(5)
    base = [f"w{i}" for i in range(25)]
    texts = [None, "", "\n\n", "a b c d e\na b c d e\n", "a b c d e", "a b c d", "a b c d"]
    for n in range(70):
        v = list(base)
        for _ in range(r.randrange(5)):
            v[r.randrange(25)] = f"x{r.randrange(90)}"
        texts.append(f"head {n}\n" + " ".join(v) + "\ntail a b c d " + "é" * (n % 3))
    r.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_removed", F.lit("x")).withColumn("lang", F.lit("en")).withColumn("gone", F.lit(1))
    out = line_dedup.drop_repeated_lines(df, least=5)
    assert out.columns == ["doc_id", "text", "lang", "gone", "n_removed"] and out.where("gone = 1").count() == len(rows)
    assert {x.doc_id: (x.n_removed, x.text) for x in out.collect()} == _lines(rows)


def _template(n):
    return [f"Posted in our news section by the site editor on day u{i} for all readers" for i in range(n)]


def test_line_dedup_template_lines_in_bounded_memory():
    """Candidates of 20,000 near-equal lines, all pairs of which pass the filters, take tens of megabytes."""
    data, offsets = words.utf8(pa.array(_template(20_000)))
    lines = line_dedup.Lines(data, offsets, 1)
    table = np.zeros(2 * line_dedup.SLOTS, np.uint8)
    common = int(line_dedup._code(np.array([19_999]))[0])
    for at in line_dedup._slots(np.unique(lines.word)):
        table[at] = common
    for at in line_dedup._slots(words.Words(*words.utf8(pa.array([f"u{i}" for i in range(20_000)]))).hash):
        table[at] = 2
    code = line_dedup._rarity(table, lines.word)
    order = np.argsort((lines.line << 8) | code, kind="stable")
    name, (low, high) = lines.names()[0], lines.parities()
    lines.word = lines.word[order]
    key, of, rank, splits = line_dedup._prefixes(lines, code[order], np.ones(20_000, bool), 4, 5, int(line_dedup._code(np.array([20_000]))[0]) + 1)
    t = {"key": key & np.uint64(0xFFFFFFFF), "name": name[of] & np.uint64(0xFFFFFFFF), "low": low[of], "high": high[of], "row": of, "place": 0 * of, "n": lines.size[of], "at": rank, "splits": splits}
    ids = np.arange(20_000)
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([line_dedup._packed(t, ids, ids)]), pa.array([False])], ["bucket", "blob", "probe"])
    tracemalloc.start()
    later, n = set(), 0
    for out in line_dedup._candidates(4, 5)([batch]):
        n += out.num_rows
        later |= set(out.column(1).drop_null().to_pylist())
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert later == set(range(1, 20_000)) and n < 20_000 * 2 * 64


def test_line_dedup_template_lines(spark):
    rows = list(enumerate(_template(1_500) + [f"Read more about topic t{i} and story s{i} in the long archive" for i in range(300)]))
    rows = [(i, f"{t}\nown{i} line{i}") for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: (x.n_removed, x.text) for x in line_dedup.drop_repeated_lines(df, least=1).collect()} == _lines(rows, least=1)


def test_line_dedup_nulls_last(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f\nother"), (5, "a b c d e f\nother")]
    got = sorted(((r.doc_id, r.text) for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == [(5, "a b c d e f\nother"), (5, "a b c d e f\nother"), (None, "")]
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_line_dedup_rows_on_one_id_or_none(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PARTNERS", 1)
    far, near = "a b c d e f g h i", "a b c d e f g h i j"
    null = [(None, f"{far}\nown one two three four"), (None, f"{near}\nown five six seven eight"), (None, f"{near} k\nown nine ten eleven twelve")]
    same = [(None, "p q r s t u")] * 3
    one = [(7, f"k l m n o p q r s {x}\nonly {x} 1 2 3 {x}4 {x}5") for x in ("x", "y", "z", "v")]
    df = spark.createDataFrame(null + same + one, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_removed, r.text) for r in line_dedup.drop_repeated_lines(df).collect()]
    text = "\n".join(t for _, _, t in got)
    # Unique lines stay, and of lines that match one stays.
    assert all(text.count(f"own {w} ") == 1 for w in ("one", "five", "nine")) and all(text.count(f"only {x} ") == 1 for x in "xyzv")
    assert text.count("a b c") == text.count("p q r s t u") == text.count("k l m n o") == 1
    assert sorted(n for i, n, _ in got if i == 7) == [0, 1, 1, 1] and sorted(n for i, n, _ in got if i is None) == [0, 0, 1, 1, 1, 1]


@pytest.mark.parametrize("num,den", [(4, 5), (1, 2), (9, 10), (1, 1)])
def test_line_dedup_short_lines(spark, num, den):
    r = random.Random(num)
    texts = ["All rights reserved.\nfirst", "second\nAll rights reserved.\n\n \n", "reserved. All  rights", "a a a a a", "a", "b a", "a b c d", "a b c d e", "d c b a"]
    texts += [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 9))) for _ in range(80)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_removed, x.text) for x in line_dedup.drop_repeated_lines(df, similarity=(num, den), least=1).collect()}
    assert got == _lines(rows, num, den, 1)


def test_line_dedup_other_ids_and_long_lines(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    rows = [("b", long + "\nHome | About"), ("a", long + " z\nHome | About"), ("c", "x " * 50_000 + "\nown line")]
    df = spark.createDataFrame(rows, "gone_id string, _row_id string").withColumn("c0", F.lit(1))
    got = line_dedup.drop_repeated_lines(df, id_col="gone_id", text_col="_row_id")
    assert got.columns == ["gone_id", "_row_id", "c0", "n_removed"]
    out = {r.gone_id: r for r in got.collect()}
    assert sorted((out["a"].n_removed, out["b"].n_removed)) == [0, 2] and out["c"].n_removed == 0


def test_line_dedup_queries_judge_short_lines(spark, tmp_path):
    docs = spark.createDataFrame([(1, "All rights reserved.\nfirst", 26), (2, "second\nAll rights reserved.", 27)], "doc_id long, text string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = [(1, "All rights reserved.\nfirst"), (2, "second")]
    assert sorted((r.doc_id, r.text) for r in queries.op9_drop_repeated_lines(spark, str(tmp_path)).collect()) == want
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_lines(spark, docs, str(tmp_path)).collect()) == want


def test_suffix_array_is_sorted():
    r = np.random.default_rng(1)
    for letters in (1, 2, 4):
        t = np.append(r.integers(97, 97 + letters, 400), 255).astype(np.uint8)
        raw = t.tobytes()
        assert suffixes.suffix_array(t, 401).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def _cut(texts, n=200):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot,finer", [(4000, 4), (1, 3), (1, 0)])
def test_remove_repeats(spark, monkeypatch, hot, finer):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "FINER", finer)
    r = random.Random(7)
    make = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    a, b = make(900), make(500)
    texts = [None, "", a, a[:450] + "X" + a[450:], make(300) + a[100:420] + make(50), b + b, b[:199], "z" * 700, "xy" * 300, *[f"{make(9)}{i} " + a[200:600] + f" {i * i}{make(30)}" + b[:260] for i in range(12)], make(150), make(150) + b[10:230], a]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("uid", F.lit(0))
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffixes.remove_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == _cut(texts)
    twice = suffixes.remove_repeats(spark.createDataFrame([(1, a), (1, a), (None, b)], "doc_id long, text string")).collect()
    assert sorted(x.n_removed for x in twice) == [0, len(a.encode()), len(a.encode())]
    assert suffixes.remove_repeats(df.limit(0)).isEmpty()


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    r = random.Random(9)
    texts = [None, "", "Hello WORLD's  \t x\n", "<|endoftext|> a", "é́ ÀÉ don't", "x" * 300] + [" ".join(r.choice(["alpha", "Beta,", "thtion", "12"]) for _ in range(r.randrange(1, 6000))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(2, texts[2])], "doc_id long, text string").withColumn("length", F.lit(0))
    rows = packing.pack_documents(df).collect()
    tok, by, bins = Tokenizer.from_file(packing.tokenizer_path()), collections.defaultdict(list), collections.defaultdict(list)
    for x in rows:
        by[x.doc_id].append((x.piece, x.start, x.length, x.ids_crc32))
        bins[x.sequence_id].append((x.offset, x.length))
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want = [(j // 2048, j, len(ids[j : j + 2048]), zlib.crc32(np.array(ids[j : j + 2048], "<u4").tobytes())) for j in range(0, len(ids), 2048)]
        assert sorted(by[i]) == sorted(want * (2 if i == 2 else 1))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= sum(x.length for x in rows) / 2048 * 1.1 + 2
    assert packing.pack_documents(df.limit(0)).isEmpty()


def test_best_fit_keeps_every_constraint():
    lengths = np.random.default_rng(2).integers(1, 200, 800)
    where, _ = packing.best_fit(lengths, tokens=500, documents=4, cost=60_000)
    for b in set(where.tolist()):
        part = lengths[where == b]
        assert part.sum() <= 500 and len(part) <= 4 and (part.astype(float) ** 2).sum() <= 60_000


def test_pack_keeps_capacities_that_bind(spark):
    lengths = [int(x) for x in np.random.default_rng(3).integers(1, 200, 900)] + [500, 300]
    pieces = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "id long, piece int, length long")
    bins = collections.defaultdict(list)
    for r in packing.pack(pieces, tokens=500, documents=4, cost=60_000, group=20_000).collect():
        bins[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, bins.values())) == len(lengths)
    for parts in bins.values():
        cost = sum(n * n for _, n in parts)
        assert sum(n for _, n in parts) <= 500 and len(parts) <= 4 and (cost <= 60_000 or len(parts) == 1)
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist()


def test_strings_are_forgotten_and_met_again(monkeypatch):
    monkeypatch.setattr(packing, "_KEPT", 50)
    known = packing._Ids(packing.tokenizer_path())
    for k in range(12):
        words = [f"w{k % 3}{i}" for i in range(40)] + ["a|b", "x" * 90]
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        start, size, _ = packing._strings(data, np.array([0, len(data)]))
        slot = known.slots(data, start, size)
        got = [known.ids[known.at[s] : known.at[s] + known.size[s]].tolist() for s in slot]
        assert got == [known._encode(w).tolist() for w in words]
    assert len(known.hash) < 100
