"""Importance resampling, filter audit and byte-level BPE: brute force, the tokenizer itself, SQL, edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parimart.llm import bpe, filter_audit, queries, resampling

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_resample_target", "op12_audit_filters"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(str(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == want


def test_position_table_crc():
    r = random.Random(1)
    data = np.frombuffer(r.randbytes(5000), np.uint8)
    spans = [(r.randrange(4000), n) for n in [0, 1, 2, 3, 4, 5, 62, 63, 64, 65, 66, 67, 68, 127, 128, 129, 131, 192, 193, 999] * 20]
    start, size = np.array(spans).T
    assert resampling.span_crc32(data, start, size).tolist() == [zlib.crc32(bytes(data[a : a + n])) for a, n in spans]


def _runs(text, longest):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def _resample(rows, target, longest, buckets, least, share, seed):
    runs = [_runs(t, longest) for _, t in rows]
    hashed = lambda xs: collections.Counter(zlib.crc32(x.encode()) % buckets for x in xs)
    s, t = hashed(x for _, f in runs for x in f), hashed(x for y in target for x in _runs(y, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (n, f) in zip(rows, runs, strict=True):
        w = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // max(1, len(f))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    may = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    drawn = may[: len(may) * share[0] // share[1]]
    ranks = collections.defaultdict(list)
    for k, x in enumerate(drawn):
        ranks[tuple(x)].append(k + 1)
    return sorted(str((*x[:4], ranks[tuple(x)].pop() if ranks[tuple(x)] else None)) for x in out)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_matches_plain_code(spark, longest):
    r = random.Random(longest)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "日本", "x" * 150, "9", "É"]
    rows = [(i % 90, " ".join(r.choice(vocabulary) for _ in range(r.randrange(12))) + r.choice(["", "!", "\x7f'--a"])) for i in range(120)]
    rows += [(None, "w1 w2 w3 w4 w5 w6"), (None, "w1 w2 w3 w4 w5 w6"), (500, None), (501, ""), (502, "... !"), (7, "w1 " * 30_000), (7, "w1 " * 30_000)]
    target = ["w1 w2 w3", None, "", "w1 straße w9"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"weight": F.lit("x"), "row": F.lit(1), "id": F.lit(2)})
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, goal, longest=longest, buckets=97, least=4, share=(1, 3), seed=7)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(tuple(x)) for x in got.collect()) == _resample(rows, target, longest, 97, 4, (1, 3), 7)


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a")], "doc_id long, text string")
    got = resampling.resample(docs, docs.select("text").limit(0), least=1, share=(1, 1)).collect()
    assert sorted(x["rank"] for x in got) == [1, 2]
    assert all(x["rank"] is None for x in resampling.resample(docs, docs, least=9).collect())
    assert resampling.resample(docs.limit(0), docs).isEmpty()


def test_positional_popcounts():
    r = np.random.default_rng(3)
    for n in (0, 1, 15, 16, 17, 1000, 70_000):
        words = r.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)
        assert filter_audit.positional_counts(words).tolist() == [int(np.count_nonzero(words >> np.uint32(b) & np.uint32(1))) for b in range(32)]


def _audit(rows, labels):
    first, marks = {}, collections.defaultdict(lambda: [False, False])
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x in labels:
        marks[i] = [marks[i][0] or q == 1, marks[i][1] or x == 1]
    judged = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first.get(t, i)]
        judged.append((part or "", fails, *(marks[i] if i is not None and i in marks else (False, False))))
    out = []
    for part in {x[0] for x in judged}:
        own, steps, total = [x for x in judged if x[0] == part], [], collections.Counter()
        for order in itertools.permutations(range(5)):
            left = own
            for k, f in enumerate(order):
                lost = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                total[f] += len(lost)
                redundant = sum(x[1][f] for x in own) - len(lost)
                alone = sum(x[1][f] and sum(x[1]) == 1 for x in own)
                steps.append((f, [part, "".join("ABCDE"[g] for g in order), k + 1, len(left), len(lost), redundant, alone, sum(x[2] for x in lost), sum(x[3] for x in lost)]))
        out += [(*x, total[f]) for f, x in steps]
    return sorted(out)


def test_filter_audit_matches_plain_code(spark):
    r = random.Random(4)
    rows = []
    for _ in range(150):
        size, kinds = r.choice([3, 99, 100, 101, 130]), r.choice([1, 5, 90, 500])
        t = " ".join(r.choice(["w", "W", "É"]) + str(r.randrange(kinds)) for _ in range(size)) + r.choice(["", "", "#", "\n| a", " x"])
        rows += [(r.randrange(200), t, r.choice(["en", "de", None, ""]))] * r.choice([1, 1, 2]) + [(r.randrange(200), t, "en")] * r.choice([0, 0, 1])
    rows += [(None, "a", "fr"), (None, "a", "fr"), (3, "a", "fr"), (4, None, "fr"), (5, "", None), (6, "Z" * 300_000, "it")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 220, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"part": F.lit(1), "digest": F.lit(2), "id": F.lit("x"), "good": F.lit(3)})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_filters(docs, marks)
    assert sorted(tuple(x) for x in got.collect()) == _audit(rows, labels)
    assert filter_audit.audit_filters(docs.limit(0), marks).isEmpty()
    assert filter_audit.audit_filters(docs, marks.limit(0)).agg(F.max("good_lost")).first()[0] == 0


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.tokenizer_path())


ODD = ["a", "l", "'", "'s", "'ll", "'re", " ", "  ", "\n", "\t", "é", "1", "9", "!", "..", "日本", "　", "\x1c", "\x85", "😀", " the", " word", "v", "e", "̀", "٠"]


def test_joined_stretches_agree_with_the_whole(tokenizer):
    worker, r = bpe._bpe(bpe.tokenizer_path()), random.Random(9)
    for _ in range(1500):
        text = "".join(r.choice(ODD) for _ in range(r.randrange(70)))
        cuts = sorted(r.choices(range(len(text) + 1), k=r.randrange(8)))
        parts = [text[a:b].encode() for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        ids = bpe.join_stretches(worker, bpe.stretches(worker, parts))
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert worker.decode(ids).tobytes().decode() == text


def test_pieces_are_the_tokenizers(tokenizer):
    worker, r = bpe._bpe(bpe.tokenizer_path()), random.Random(10)
    texts = ["".join(r.choice([*ODD, "\u2028", "<|endoftext|>", "ǅ", "Ⅷ", "²", "\u200b", "x's't're"]) for _ in range(r.randrange(40))) for _ in range(1500)]
    for text, ids in zip(texts, bpe.encode_texts(worker, [t.encode() for t in texts]), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    sizes = [len(t.encode()) for t in texts]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum(sizes)])
    want = [at + sum(len(m) for m, _ in pieces[:k]) for at, t in zip(offsets, texts) for pieces in [worker.split(t)] for k in range(len(pieces))]
    assert worker.piece_starts(data, offsets).tolist() == want


def test_chunks_follow_the_content():
    r = random.Random(2)
    passage = " ".join(f"word{r.randrange(999)}" for _ in range(900))
    texts = ["", f"intro é {passage} end", "日" * 9000, "x", f"{passage}{'a' * 9000}"]
    cut = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        start, end = bpe.chunk_ends(data, np.array([0, len(data)]))
        pieces = [t.encode()[a:b] for a, b in zip(start, end, strict=True)]
        assert "".join(p.decode() for p in pieces) == t and all(len(p) <= bpe.MOST + 3 for p in pieces)
        cut.append(set(pieces))
    shared = cut[1] & cut[4]
    assert sum(map(len, shared)) > 0.6 * len(passage)


def _bpe_rows():
    r = random.Random(6)
    passages = [" ".join(f"{r.choice(['the', 'Of', 'naïve', '日本'])}{r.randrange(3000)}" for _ in range(300)) for _ in range(6)]
    rows = [(i, r.choice(["", "Start'", "x\n"]) + r.choice(passages) + r.choice([" ", "'s ", "\n\n"]) + f"own {i} " * 30 + r.choice(passages)) for i in range(60)]
    rows += [(3, passages[0]), (3, passages[0]), (3, passages[1]), (None, passages[0]), (None, None), (900, None), (901, ""), (902, "a <|endoftext|> b"), (903, f"{passages[0]}<|endoftext|>{passages[0]}")]
    return rows + [(904, "a" * 60_000), (905, "word " * 40_000), (906, "".join(r.choice(ODD) for _ in range(20_000)))]


@pytest.mark.parametrize("bits,heavy", [(25, 200), (6, 10**9), (25, 0)])
def test_bpe_matches_the_tokenizer(spark, tokenizer, monkeypatch, bits, heavy):
    monkeypatch.setattr(bpe, "HEAVY", heavy)
    rows = _bpe_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "row": F.lit(1), "h": F.lit(2)}).repartition(3)
    got = bpe.encode_decode(df, bits=bits, texts=True)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        raw, back = np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)
        want.append(str((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), raw, back)))
    assert sorted(str((*x[:4], bytes(x[4]), x[5])) for x in got.collect()) == sorted(want)
    assert bpe.encode_decode(df.limit(0)).isEmpty()


def test_bpe_rejects_other_tokenizers(spark):
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        bpe._Bpe(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_query_matches_the_tokenizer(spark, tokenizer):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_encode_decode(spark, SF).collect()
    assert len(got) == len(texts)
    for x in got:
        ids = tokenizer.encode(texts[x.doc_id], add_special_tokens=False).ids
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256(texts[x.doc_id].encode()).hexdigest()
