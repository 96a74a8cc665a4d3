"""The registered queries of this package: thin bindings of its operators to the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import bpe, chat, exact_dedup, filter_audit, fingerprints, line_dedup, mixing, ngram_join, packing, quality, resampling, secrets, suffixes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op3_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), k=4, similarity=(85, 100))


def op4_rotate_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op5_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    held = (quality.remainder("doc_id") == 2).alias("held_out")
    return quality.score_quality(docs, model).select("doc_id", held, "score", "predicted")


def op6_find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.find_secrets(docs, secrets.train(secrets.labelled_samples(docs)))


def op7_fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op8_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op9_drop_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), least=1)
    return lines.select("doc_id", "n_removed", "text")


def op10_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op11_resample_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_audit_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_mix_sources, op3_jaccard_components, op4_rotate_perspectives, op5_score_quality, op6_find_secrets,
        op7_fingerprint_edits, op8_remove_repeats, op9_drop_repeated_lines, op10_pack_documents, op11_resample_target,
        op12_audit_filters, op13_encode_decode,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id is not distinct from max(doc_id) over same as kept, sha256(t) as text_sha256
        from (select doc_id, coalesce(text, '') as t from documents)
        window same as (partition by t)
    """,
    "op2_mix_sources": r"""
        with sizes as (
            select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
                   substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 2) as b
            from documents
        ), weighed as (
            select source, cast(sum(size) as bigint) as source_size,
                   [3.0, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w
            from sizes group by source
        ), levels as (
            select *, 2.0::double * source_size as room,
                   (1.5::double * sum(source_size) over () - 2.0::double * coalesce(sum(source_size) over so_far, 0))
                   / (sum(w) over () - coalesce(sum(w) over so_far, 0)) as level
            from weighed
            window so_far as (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding)
        ), filled as (
            select *, first_value(case when level * w <= room then level end ignore nulls) over (
                       order by source_size / w, source nulls last rows between unbounded preceding and current row) as first
            from levels
        ), targets as (
            select source, source_size, coalesce(first * w, room) as target,
                   case when source_size > 0 then coalesce(first * w, room) / source_size else 0 end as rate,
                   cast('0x' || substr(md5(coalesce(source, '')), 1, 8) as bigint) / 4294967296.0::double as u
            from filled
        ), ranked as (
            select *, row_number() over (partition by source order by size, b, doc_id nulls last) as rank from sizes
        )
        select r.doc_id, r.size, t.source_size, t.target,
               cast(floor(r.rank * rate + u) - floor((r.rank - 1) * rate + u) as bigint) as copies,
               cast((floor(r.rank * rate + u) - floor((r.rank - 1) * rate + u)) * r.size as bigint) as taken
        from ranked r join targets t on r.source is not distinct from t.source
    """,
    "op4_rotate_perspectives": """
        with t as (
            select conv_id, cast(coalesce(turn // 512, 0) as bigint) as segment, turn,
                   coalesce(role, 'unknown') as role, replace(coalesce(text, ''), '<|', '< |') as text
            from conversations
        ), lines as (
            select t.conv_id, w.speaker, t.segment, t.turn, t.role, t.text,
                   case when t.role = w.speaker then '<|assistant|>' || chr(10)
                        else '<|user name=' || replace(replace(replace(replace(replace(
                            t.role, '%', '%25'), '|', '%7C'), '<', '%3C'), '>', '%3E'), chr(10), '%0A') || '|>' || chr(10)
                   end as head,
                   t.text || '<|end|>' || chr(10) as body, t.role = w.speaker as own
            from t join (select distinct conv_id, role as speaker from t) w on t.conv_id is not distinct from w.conv_id
        ), placed as (
            select *, sum(length(head) + length(body)) over (
                       partition by conv_id, speaker, segment order by turn nulls first, role, text
                       rows between unbounded preceding and current row) as stop
            from lines
        )
        select conv_id, speaker, segment,
               string_agg(head || body, '' order by turn nulls first, role, text) as rendered,
               coalesce(string_agg(case when own then cast(stop - length(body) as varchar) || ':' || cast(stop as varchar) end,
                                   ',' order by turn nulls first, role, text), '') as mask,
               count(*) as n_turns, count(*) filter (where own) as n_masked
        from placed group by conv_id, speaker, segment
    """,
    "op11_resample_target": r"""
        with recursive steps as (
            select i, i as crc, 0 as k from range(256) t(i)
            union all
            select i, case when crc & 1 = 1 then xor(crc >> 1, 3988292384) else crc >> 1 end, k + 1 from steps where k < 8
        ), bytes as (select list(crc order by i) as crcs from steps where k = 8
        ), texts as (
            select 0 as side, row_number() over () as row, doc_id, text from documents union all select 1, 0, null, text from benchmark
        ), words as (
            select side, row, unnest(regexp_extract_all(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word
            from texts
        ), hashed as (
            select word, xor(list_reduce(
                       list_prepend(4294967295, [('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::bigint for i in range(1, octet_length(encode(word)) + 1)]),
                       lambda c, b: xor(c >> 8, crcs[xor(c & 255, b) + 1])), 4294967295) % 10000 as bucket
            from (select distinct word from words), bytes
        ), used as (select side, row, bucket from words join hashed using (word)
        ), counts as (
            select b as bucket, count(u.bucket) filter (where side = 0) as s, count(u.bucket) filter (where side = 1) as t
            from range(10000) r(b) left join used u on u.bucket = r.b group by b
        ), gains as (
            select bucket, floor(1000 * ln(((t + 1)::double * ((sum(s) over ())::double + 10000)) / ((s + 1)::double * ((sum(t) over ())::double + 10000))))::bigint as gain
            from counts
        ), weighed as (
            select row, count(*) as n_features, floor(sum(gain) / count(*))::bigint as weight from used join gains using (bucket) where side = 0 group by row
        ), scored as (
            select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
            from texts left join weighed using (row) where side = 0
        ), ranked as (
            select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last, n_features, weight) as k,
                   10 * (count(*) filter (where n_features >= 20) over ()) // 100 as n
            from scored
        )
        select doc_id, n_features, weight, score, case when n_features >= 20 and k <= n then k end as rank from ranked
    """,
    "op12_audit_filters": r"""
        with marks as (
            select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels where doc_id is not null group by doc_id
        ), docs as (
            select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
        ), judged as (
            select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
                   [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
                    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'),
                    coalesce(doc_id > min(doc_id) over (partition by text), false)] as fails
            from docs left join marks using (doc_id)
        ), orders as (
            select [a, b, c, d, e] as f from range(1, 6) t1(a), range(1, 6) t2(b), range(1, 6) t3(c), range(1, 6) t4(d), range(1, 6) t5(e)
            where len(list_distinct([a, b, c, d, e])) = 5
        ), grouped as (
            select part, fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from judged group by part, fails
        ), met as (
            select g.*, f, step, f[step] as own, fails[f[step]] as failing,
                   list_bool_or([false] || [fails[x] for x in f[1:step - 1]]) as gone,
                   list_count([x for x in fails if x]) = 1 as alone
            from grouped g, orders, range(1, 6) t(step)
        ), steps as (
            select part, f, step, any_value(own) as own,
                   coalesce(sum(n) filter (where not gone and not failing), 0) as kept, coalesce(sum(n) filter (where not gone and failing), 0) as removed,
                   coalesce(sum(n) filter (where gone and failing), 0) as redundant, coalesce(sum(n) filter (where failing and alone), 0) as unique_fails,
                   coalesce(sum(good) filter (where not gone and failing), 0) as good_lost, coalesce(sum(toxic) filter (where not gone and failing), 0) as toxic_lost
            from met group by part, f, step
        )
        select part, array_to_string([substr('ABCDE', x, 1) for x in f], '') as filter_order, step::int as step,
               kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
               good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley
        from steps
    """,
}
