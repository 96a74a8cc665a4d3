"""Secret scans: fixed patterns, and character Markov models for what they miss (DataFrame functions only)."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns and how long what they find must be.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24

#: What the models judge: whole words of these characters, of 16 or more, or of 8 or more if they have a digit or a capital
#: after a small letter. Shorter ones in small letters alone can't be told from words of any language.
TOKEN = (
    r"(?<![\p{L}\p{N}+/_=-])(?=[A-Za-z0-9+/_=-]{16}|[A-Za-z+/_=-]*+[0-9]|[A-Z0-9+/_=-]*+[a-z]++[a-z0-9+/_=-]*+[A-Z])"
    r"[A-Za-z0-9+/_=-]{8,}+(?![\p{L}\p{N}])"
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: The share of ordinary samples of any kind, held out from training, that may count as random; and the log-likelihood
#: ratio that a token must reach at least: odds of one random string to so many ordinary ones before it is looked at.
FALSE_POSITIVES, LEAST_RATIO = 0.001, math.log(10_000)
#: Pairs, of 100,000 for each kind of sample, that go by kinds of characters.
BACK_OFF = 3000
#: Samples of each kind that the bundled set has, and what they are made from: alphabets, and words of identifiers.
SAMPLES = 3000
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {
    "hex": _DIGITS + "abcdef", "upper hex": _DIGITS + "ABCDEF", "base32": _UPPER + "234567", "base36": _LOWER + _DIGITS,
    "base62": _UPPER + _LOWER + _DIGITS, "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_",
    "lower": _LOWER, "letters": _UPPER + _LOWER,
}
WORDS = (
    "account address array batch border bucket buffer build button cache child client cluster color column config content count "
    "create cursor customer data default delete detail device domain engine entry error event export factory feature field file filter "
    "format frame group handler header height image import index input invoice item label layout length level list local manager "
    "message method model module month name network node number object offset option order output package page parent partition path "
    "payload period policy price product profile project query queue range record region report request response result route sample "
    "schema score search section sensor service session shipment signal source stage status storage stream string summary system table "
    "target task template thread time total track transfer update user value vector version view volume warehouse width window worker"
).split()
KINDS = ("assign", "access", "hex", "markov")
_SPANS = "array<struct<s:int,k:int,e:int>>"


def _found(text: Column, pattern: str, kind: int, keep, rough: str | None = None) -> Column:
    """Spans of the matches that ``keep(match, group 2)`` holds for, positions in code points.

    split() gives what lies between the matches, so running lengths give the positions. ``rough`` is a cheaper
    pattern that matches wherever a match could be kept; other texts are passed over at once.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == 0 else hits
    steps = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("g"), hits.alias("m"), second.alias("x")),
        lambda z: F.struct(
            F.length(z["g"]).alias("g"), F.coalesce(F.length(z["m"]), F.lit(0)).alias("m"), keep(z["m"], z["x"]).alias("ok")
        ),
    )
    spans = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out")),
        lambda a, z: F.struct(
            (a["at"] + z["g"] + z["m"]).alias("at"),
            F.when(
                z["ok"],
                F.concat(
                    a["out"],
                    F.array(F.struct((a["at"] + z["g"]).alias("s"), F.lit(kind).alias("k"), (a["at"] + z["g"] + z["m"]).alias("e"))),
                ),
            ).otherwise(a["out"]).alias("out"),
        ),
    )["out"]
    return F.when(text.rlike(rough or pattern), spans).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> list[Column]:
    """The spans of the three base kinds: whole matches, leftmost and not overlapping, short ones dropped."""

    def least(n):
        return lambda m, x: F.coalesce(F.length(x) >= n, F.lit(False))

    return [
        _found(text, ASSIGN, 0, least(ASSIGN_MIN)),
        _found(text, ACCESS, 1, least(ACCESS_MIN), "AKIA[A-Z0-9]{%d}" % (ACCESS_MIN - 4)),
        _found(text, HEX, 2, least(HEX_MIN), "[0-9a-f]{%d}" % HEX_MIN),
    ]


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), F.ascii)


class Model(NamedTuple):
    """``ratio``: log-likelihood ratio of each pair of ASCII characters; ``threshold``: the sum from which a token is random."""

    ratio: list[float]
    threshold: float


def _number(*salt) -> Column:
    return F.abs(F.xxhash64("id", *[F.lit(x) for x in salt]))


def _word(salt: int) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in WORDS]), (_number(salt) % len(WORDS) + 1).cast("int"))


def _drawn(letters: str, salt: int) -> Column:
    def letter(j: Column) -> Column:
        return F.substring(F.lit(letters), (F.abs(F.xxhash64("id", j, F.lit(salt))) % len(letters) + 1).cast("int"), F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(1), (F.lit(12) + _number(salt) % 53).cast("int")), letter), "")


def bundled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """``(label, part, sample)``: ``n`` samples of every kind, made by rule from hashes of their numbers.

    Random strings (label 1) are drawn evenly from each of ``ALPHABETS``, 12 to 64 characters long. Ordinary identifiers
    (label 0) are two to four ``WORDS`` in camel, snake, kebab or capital letters, with or without a number of up to four
    digits or a version, dates with times, paths, and plain numbers.
    """
    ids = spark.range(0, n, 1, 1)
    out = []
    for k, (part, letters) in enumerate(ALPHABETS.items()):
        out.append(ids.select(F.lit(1).alias("label"), F.lit(part).alias("part"), _drawn(letters, k).alias("sample")))
    words = F.slice(F.array(*[_word(j) for j in range(4)]), 1, (F.lit(2) + _number(90) % 3).cast("int"))
    tail = (
        F.when(_number(91) % 4 == 0, (_number(92) % 10_000).cast("string"))
        .when(_number(91) % 4 == 1, F.concat(F.lit("v"), (_number(93) % 20).cast("string"))).otherwise("")
    )
    joint = F.when(_number(94) % 2 == 0, F.lit("")).otherwise(F.lit("_"))
    named = F.transform(words, lambda w: F.initcap(w))
    camel = F.concat(F.element_at(words, 1), F.array_join(F.slice(named, 2, 3), ""))
    day = F.date_add(F.lit("1995-01-01").cast("date"), (_number(95) % 15_000).cast("int"))
    clock = F.lpad((_number(96) % 240_000).cast("string"), 6, "0")
    ordinary = {
        "camel": F.concat(camel, tail), "pascal": F.concat(F.array_join(named, ""), tail), "snake": F.concat(F.array_join(words, "_"), joint, tail),
        "kebab": F.concat(F.array_join(words, "-"), F.when(tail != "", F.concat(F.lit("-"), tail)).otherwise("")),
        "capitals": F.concat(F.upper(F.array_join(words, "_")), joint, F.upper(tail)), "path": F.concat(F.lit("/"), F.array_join(words, "/"), tail),
        "joined": F.concat(F.array_join(words, ""), tail),
        "dated": F.concat(_word(97), F.lit("-"), F.date_format(day, "yyyy-MM-dd"), F.when(_number(98) % 2 == 0, F.concat(F.lit("-"), clock)).otherwise("")),
        "compact": F.concat(_word(97), joint, F.date_format(day, "yyyyMMdd"), F.lit("T"), clock),
        "number": F.substring(F.concat(_number(99).cast("string"), _number(100).cast("string")), 1, 24),
    }
    for part, made in ordinary.items():
        out.append(ids.select(F.lit(0).alias("label"), F.lit(part).alias("part"), made.alias("sample")))
    every = out[0]
    for frame in out[1:]:
        every = every.unionByName(frame)
    return every


def _kind(c: str) -> str:
    return "A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c


def _conditional(count: dict[str, float], alpha: float) -> dict[str, float]:
    """Probability of each pair's second character after its first.

    What was counted is mixed with ``BACK_OFF`` pairs as kinds of characters (capital, small letter, digit) follow each
    other, so that two words whose ends seldom meet, or a rare digit, don't make an identifier random.
    """
    kinds: dict[str, float] = {}
    single: dict[str, float] = {}
    for p, n in count.items():
        of = _kind(p[0]) + _kind(p[1])
        kinds[of] = kinds.get(of, 0.0) + n
        single[p[1]] = single.get(p[1], 0.0) + n
    every = sorted({_kind(c) for c in ALPHABET})
    of_kind = {k: [c for c in ALPHABET if _kind(c) == k] for k in every}
    mass = {k: sum(single.get(c, 0.0) + alpha for c in of_kind[k]) for k in every}
    after = {k: sum(kinds.get(k + x, 0.0) + alpha for x in every) for k in every}
    rows = {a: sum(count.get(a + b, 0.0) for b in ALPHABET) for a in ALPHABET}
    out = {}
    for a in ALPHABET:
        for b in ALPHABET:
            x, y = _kind(a), _kind(b)
            rough = (kinds.get(x + y, 0.0) + alpha) / after[x] * (single.get(b, 0.0) + alpha) / mass[y]
            out[a + b] = (count.get(a + b, 0.0) + BACK_OFF * rough) / (rows[a] + BACK_OFF)
    return out


def train(samples: DataFrame, token_col: str = "sample", label_col: str = "label", alpha: float = 0.5) -> Model:
    """First-order Markov models of random strings (label 1) and ordinary identifiers (label 0), and their threshold.

    ``samples`` are added to the bundled ones. Each kind has the same weight in its model, so that frequent words don't
    hide rarer styles; ``alpha`` is added to every pair. An eighth of the samples, by hash, is held out: the threshold is the
    least that no more than ``FALSE_POSITIVES`` of any bundled ordinary kind reach, and ``LEAST_RATIO`` at least. What comes
    back to the driver is one count for each kind, label and pair of ``ALPHABET``, whatever the number of samples. Null or
    one-character samples teach nothing.
    """
    token = F.col("sample")
    given = samples.select(F.col(label_col).cast("int").alias("label"), F.lit("given").alias("part"), F.col(token_col).alias("sample"))
    bundled = bundled_samples(samples.sparkSession)
    held_out = F.abs(F.xxhash64(token)) % 8 == 0
    known = "".join(c if c.isalnum() else "\\" + c for c in ALPHABET)
    pairs = (
        given.unionByName(bundled).where((F.length(token) > 1) & ~held_out)
        .select("label", "part", F.explode(F.regexp_extract_all(token, F.lit(f"(?=([{known}]{{2}}))"), F.lit(1))).alias("p"))
        .groupBy("label", "part", "p").agg(F.count(F.lit(1)).alias("n"))
    )
    counts: dict[tuple[int, str], dict[str, int]] = {}
    for r in pairs.collect():
        counts.setdefault((r["label"], r["part"]), {})[r["p"]] = r["n"]
    weight: dict[tuple[int, str], float] = {}
    for (label, _), found in counts.items():
        scale = 100_000 / sum(found.values())
        for p, n in found.items():
            weight[label, p] = weight.get((label, p), 0.0) + n * scale
    like = [_conditional({p: n for (label, p), n in weight.items() if label == y}, alpha) for y in (0, 1)]
    ratio = [0.0] * (128 * 128)
    for p, random in like[1].items():
        ratio[ord(p[0]) * 128 + ord(p[1])] = round(math.log(random / like[0][p]), 6)
    model = F.split(F.lit(" ".join(map(str, ratio))), " ").cast("array<double>")
    tails = (
        bundled.where((F.col("label") == 0) & held_out).groupBy("part")
        .agg(F.percentile_approx(_sum_ratio(token, model), F.lit(1 - FALSE_POSITIVES), F.lit(100_000)).alias("s"))
    )
    return Model(ratio, max([LEAST_RATIO, *(r["s"] for r in tails.collect())]))


def _sum_ratio(token: Column, ratio: Column) -> Column:
    """The log-likelihood ratio of a token: the longer it is, the more there is to tell."""
    codes = _codes(token)
    return F.aggregate(
        F.zip_with(F.slice(codes, 1, F.length(token) - 1), F.slice(codes, 2, F.length(token) - 1), lambda a, b: a * 128 + b),
        F.lit(0.0),
        lambda s, i: s + F.element_at(ratio, i + 1),
    )


def _join(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(
        F.array_sort(spans),
        lambda z: F.concat_ws(":", F.element_at(names, z["k"] + 1), z["s"].cast("string"), z["e"].cast("string")),
    )
    return F.array_join(one, ",")


def _of_kind(kind: int):
    return lambda z: z["k"] == kind


def labelled_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Samples that the corpus itself labels: what base patterns find, and all other tokens."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<string>")
    values = F.when(text.rlike(ASSIGN), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))).otherwise(none)
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    fixed = f"AKIA[A-Z0-9]{{{ACCESS_MIN - 4}}}|[0-9a-f]{{{HEX_MIN}}}"
    found = docs.select(values.alias("v"), tokens.alias("t"))
    known = F.concat(F.filter("v", lambda x: F.length(x) >= 16), F.filter("t", lambda x: x.rlike(fixed)))
    plain = F.filter("t", lambda x: ~x.rlike(fixed) & ~F.array_contains("v", x))
    both = F.concat(
        F.transform(known, lambda x: F.struct(F.lit(1).alias("label"), x.alias("sample"))),
        F.transform(plain, lambda x: F.struct(F.lit(0).alias("label"), x.alias("sample"))),
    )
    return found.select(F.explode(both).alias("z")).select("z.label", "z.sample")


def find_secrets(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None
) -> DataFrame:
    """One row per document: id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``n_markov``,
    ``n_beyond_base``.

    ``model`` comes from ``train``. A token is added as "markov" if its log-likelihood ratio reaches the model's (or another)
    ``threshold``, whether a base span covers it, as these may cover each other, or not; ``n_beyond_base`` counts those
    that none touches. Null or empty texts have no spans; repeated rows and ids are rows of
    their own; other columns are ignored. Every row is judged by itself: there is no shuffle.
    """
    least = model.threshold if threshold is None else threshold
    ratio = model.ratio
    ratios = F.split(F.lit(" ".join(map(str, ratio))), " ").cast("array<double>")
    text = F.col("text")
    seen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = seen.withColumn("base", F.concat(*base_spans(text)))
    more = _found(
        text, TOKEN, 3,
        lambda m, x: F.coalesce(_sum_ratio(m, ratios) >= least, F.lit(False)),
    )
    clear = F.filter("more", lambda z: ~F.exists("base", lambda b: (b["s"] < z["e"]) & (z["s"] < b["e"])))
    return (
        base.withColumn("more", more)
        .withColumn("clear", clear)
        .select(
            F.col("id").alias(id_col),
            *[F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{KINDS[i]}") for i in range(3)],
            F.sha2(_join(F.col("base")).cast("binary"), 256).alias("base_sha256"),
            _join(F.concat("base", "more")).alias("spans"),
            F.size("more").cast("long").alias("n_markov"), F.size("clear").cast("long").alias("n_beyond_base"),
        )
    )
