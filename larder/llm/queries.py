"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import covertree, decontam, lexical, license, linededup, packing, productcode, sadedup, sentencepieces, sharding, simhash, toxicity, urlfilter
from .staging import small_batches

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
#: Documents and attention cost have the capacities that 2,048 tokens imply, so they never take a sequence more than tokens need; the residuals of all three choose the sequence.
PACKING = {"max_docs": None, "max_attention": None, "weights": (1.0, 1.0, 1.0), "rule": "norm"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), max_rows=20_000)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=2048, end_id=0, **PACKING)


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), shards=16)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sadedup.remove_repeats(read(spark, sf_dir, "documents"), length=400)


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, radius=4, seed=42)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(read(spark, sf_dir, "documents"), run=2, alone=50)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("kept_sha256"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepieces.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


def op13_product_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = productcode.encode(read(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return out.select("vec_id", "code", "error", "label_error", F.sha2("codebooks", 256).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_pack": op2_pack,
    "op3_shard": op3_shard,
    "op4_url_filter": op4_url_filter,
    "op5_decontaminate": op5_decontaminate,
    "op6_top_k": op6_top_k,
    "op7_license_scan": op7_license_scan,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_simhash_components": op9_simhash_components,
    "op10_line_dedup": op10_line_dedup,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_lexical_search": op12_lexical_search,
    "op13_product_code": op13_product_code,
}

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def code_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Codebooks as one common table a round, every entry compared."""
    ctes = [
        f"""v as (select row_number() over (order by vec_id) as r, vec_id, label, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v from embeddings
            where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"p as materialized (select r, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] as x from v, range({parts}) t(part))",
        f"b0 as (select part, r - 1 as entry, x as c from p where r <= {entries})",
    ]
    near = "select p.r, p.part, {best} from p join b{k} b using (part) group by p.r, p.part"
    distance = "list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for k in range(rounds):
        ctes.append(f"a{k} as materialized ({near.format(k=k, best=f'arg_min(b.entry, ({distance}, b.entry)) as entry')})")
        ctes.append(f"s{k} as (select part, entry, i, sum(x[i]) as total, count(*) as n from (select part, entry, x, unnest(range(1, len(x) + 1)) as i from a{k} join p using (r, part)) group by all)")
        ctes.append(f"m{k} as (select part, entry, list(cast((total - ((total % n) + n) % n) // n as bigint) order by i) as c from s{k} group by all)")
        ctes.append(f"b{k + 1} as materialized (select part, entry, coalesce(m{k}.c, b{k}.c) as c from b{k} left join m{k} using (part, entry))")
    ctes.append(f"z as ({near.format(k=rounds, best=f'min(({distance}, b.entry)) as got')})")
    ctes.append("e as (select r, string_agg(printf('%02x', got[2]), '' order by part) as code, cast(sum(got[1]) as bigint) as error from z group by r)")
    ctes.append(f"h as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as sha from b{rounds})")
    return f"with {', '.join(ctes)} select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, sha as codebooks_sha256 from v join e using (r), h"


def license_sql() -> str:
    """Diagonal voting as SQL: grams, votes by diagonal, bands of neighbouring diagonals."""
    listed = [(n, text.split(), label, n < len(license.PHRASES)) for n, (text, label) in enumerate([*license.PHRASES.items(), *license.NOTICES])]
    rows = ", ".join(f"('{' '.join(w[q : q + 3])}', {n}, '{label}', {base}, {len(w) - 2}, {q})" for n, w, label, base in listed for q in range(len(w) - 2))
    return f"""
        with templates(gram, template, label, base, size, q) as (values {rows}),
        d as (select doc_id, {WORDS} as w from documents),
        g as (select doc_id, a - 1 as p, w[a] || ' ' || w[a + 1] || ' ' || w[a + 2] as gram from (select doc_id, w, unnest(range(1, len(w) - 1)) as a from d)),
        v as (select doc_id, template, label, base, size, p - q as diagonal, list(distinct q) as hit from g join templates using (gram) group by all),
        b as (select *, sum(case when before is null or diagonal - before > 3 then 1 else 0 end) over (partition by doc_id, template order by diagonal) as band
            from (select *, lag(diagonal) over (partition by doc_id, template order by diagonal) as before from v)),
        s as (select doc_id, template, label, base, size, band, len(list_distinct(flatten(list(hit)))) as hits, list(diagonal) filter (where len(hit) = size) as places from b group by all),
        t as (select doc_id, label, base, size, hits, coalesce(places, []) as places, base and len(coalesce(places, [])) > 0 as whole,
            not base and hits >= case when size < 10 then size else 0.7 * size end as near from s),
        r as (select doc_id, cast(sum(case when base then len(places) else 0 end) as bigint) as n_base, min(list_min(places)) filter (where whole) as first_word, max(list_max(places)) filter (where whole) as last_word,
            coalesce(string_agg(distinct label, ',' order by label) filter (where whole), '') as base_labels, coalesce(string_agg(distinct label, ',' order by label) filter (where whole or near), '') as labels, max(hits / cast(size as double)) as score from t group by doc_id)
        select d.doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0) as score
        from d left join r on r.doc_id = d.doc_id
    """


def trust_sql(rounds: int = 9, damping: float = 0.85, threshold: float = 0.075) -> str:
    """Rules, host edges and two PageRanks with one common table a round."""
    ordered = sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for _, h, p in ordered]
    pick = lambda values: "case " + " ".join(f"when {f} then '{x}'" for f, x in zip(fits, values, strict=True)) + " end"
    host = lambda c: f"translate(regexp_extract({c}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"u as (select page_id, {host('x')} as host, regexp_extract(x, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path, html from (select *, coalesce(url, '') as x from pages))",
        f"seen as (select *, {pick([h + p for _, h, p in ordered])} as rule, {pick([v for v, _, _ in ordered])} as said from u)",
        "hosts as (select host, count(*) filter (where said = 'allow') / cast(count(*) as double) as allowed, count(*) filter (where said = 'block') / cast(count(*) as double) as blocked from seen where host <> '' group by host)",
        f"targets as (select host as src, case when starts_with(l, $$//$$) then $$:$$ || l else l end as l from (select host, unnest(regexp_extract_all(html, '{urlfilter.LINK.replace("'", "''")}', 1)) as l from u))",
        f"links as (select src, {host('l')} as host, regexp_extract(l, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from targets)",
        f"told as (select *, {pick([v for v, _, _ in ordered])} as said from links where src <> '' and host <> '' and src <> host)",
        "edges as (select src, host as dst, count(*) as n from told group by src, host)",
        "seeds as (select * from hosts union all select host, count(*) filter (where said = 'allow') / cast(count(*) as double), count(*) filter (where said = 'block') / cast(count(*) as double) from told where host not in (select host from hosts) group by host)",
    ]
    for kind, seed, a, b in (("t", "allowed", "src", "dst"), ("b", "blocked", "dst", "src")):
        ctes.append(f"{kind}e as (select {a} as src, {b} as dst, n / cast(sum(n) over (partition by {a}) as double) as share from edges)")
        ctes.append(f"{kind}0 as (select host, {seed} * {1 - damping} as score from seeds where {seed} > 0)")
        for k in range(rounds):
            ctes.append(f"{kind}{k + 1} as (select host, sum(score) as score from (select * from {kind}0 union all select dst, score * share * {damping} from {kind}e join {kind}{k} on host = src) group by host)")
    return f"""with {", ".join(ctes)} select page_id, s.host, path, rule, coalesce(said, case when x >= {threshold} and x > t then 'block' else 'allow' end) as verdict, t as trust, x as distrust
        from (select seen.*, round(coalesce(a.score, 0), 9) as t, round(coalesce(b.score, 0), 9) as x from seen left join t{rounds} a on a.host = seen.host left join b{rounds} b on b.host = seen.host) s"""


ORACLES: dict[str, str] = {
    "op4_url_filter": trust_sql(),
    "op5_decontaminate": f"""
        with d as (select doc_id, {WORDS} as w from documents), i as (select cast(item_id as varchar) as item, {WORDS} as w from benchmark),
        g as (select distinct item, least(13, len(w)) as n, array_to_string(list_slice(w, a, a + least(13, len(w)) - 1), ' ') as t from (select item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as a from i where len(w) > 0)),
        x as (select doc_id, n, a, array_to_string(list_slice(w, a, a + n - 1), ' ') as t from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as a from d cross join (select distinct n from g))),
        h as (select doc_id, a, x.n, item from x join g on g.t = x.t and g.n = x.n),
        c as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(a, a + n)) as p from h) group by doc_id),
        s as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by doc_id)
        select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(w) as contaminated
        from d left join c on c.doc_id = d.doc_id left join s on s.doc_id = d.doc_id
    """,
    "op7_license_scan": license_sql(),
    "op6_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
            where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
        r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 5
    """,
    "op8_suffix_dedup": """
        with t as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
        w as (select r, unnest(range(1, octet_length(b) - 398)) as a, b from t),
        h as (select r, a, md5(b[a:a + 399]) as m from w),
        again as (select r, a from (select r, a, count(*) over (partition by m) as n from h) where n > 1),
        s as (select r, a, sum(case when a - before <= 400 then 0 else 1 end) over (partition by r order by a) as run from (select r, a, lag(a) over (partition by r order by a) as before from again)),
        runs as (select r, run, min(a) as x, max(a) + 400 as y from s group by all),
        kept as (select r, count(*) as n, sum(y - x) as gone, list(struct_pack(x := x, y := y) order by x) as l from runs group by r),
        p as (select r, unnest(list_prepend(1, list_transform(l, lambda e: e.y))) as x, unnest(list_append(list_transform(l, lambda e: e.x), null)) as y from kept),
        rest as (select p.r, sha256(unhex(coalesce(string_agg(hex(b[p.x:coalesce(p.y, octet_length(b) + 1) - 1]), '' order by p.x), ''))) as sha from p join t using (r) group by p.r)
        select doc_id, octet_length(b) as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(n, 0) as n_spans, coalesce(sha, sha256(b)) as kept_sha256
        from t left join kept using (r) left join rest using (r)
    """,
    "op10_line_dedup": r"""
        with l as (select doc_id, text, string_split(text, chr(10)) as w from documents where text is not null),
        x as (select doc_id, unnest(range(1, len(w) + 1)) as a, w from l),
        g as (select doc_id, a, 2 as size, w[a] || chr(10) || w[a + 1] as t from x where a < len(w)
            union all select doc_id, a, 1, w[a] from x where len(regexp_extract_all(w[a], '[^ \t\n\x0B\f\r]+')) >= 50),
        f as (select *, row_number() over (partition by size, t order by doc_id, a) as k from g),
        later as (select doc_id, a, size from f where k > 1),
        gone as (select distinct doc_id, a from (select doc_id, a from later union all select doc_id, a + 1 from later where size = 2)),
        runs as (select doc_id, count(*) as n_removed, count(*) filter (where not exists
            (select 1 from gone p where p.doc_id = gone.doc_id and p.a = gone.a - 1)) as n_runs from gone group by doc_id),
        every as (select doc_id, unnest(range(1, len(w) + 1)) as a, w from l),
        kept as (select every.doc_id, string_agg(w[every.a], chr(10) order by every.a) as t
            from every left join gone on gone.doc_id = every.doc_id and gone.a = every.a where gone.a is null group by every.doc_id)
        select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) as n_lines, coalesce(n_removed, 0) as n_removed,
            coalesce(n_runs, 0) as n_runs, case when d.text is not null then sha256(coalesce(kept.t, '')) end as kept_sha256
        from documents d left join runs on runs.doc_id = d.doc_id left join kept on kept.doc_id = d.doc_id
    """,
    "op12_lexical_search": f"""
        with d as (select row_number() over () as r, doc_id, {TERMS} as w from documents),
        size as (select r, doc_id, cast(len(w) as bigint) as n from d where len(w) > 0),
        total as (select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as terms from size),
        i as (select distinct item_id, unnest({TERMS}) as t from benchmark),
        p as (select r, t, cast(count(*) as bigint) as tf from (select r, unnest(w) as t from d) where t in (select t from i) group by all),
        f as (select t, cast(floor(1000 * ln((2 * docs + 2) / cast(2 * df + 1 as double))) as bigint) as w from (select t, count(*) as df from p group by t), total),
        s as (select item_id, r, cast(sum(f.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) as bigint) as score
            from i join p using (t) join f using (t) join size using (r), total group by item_id, r),
        o as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from s join size using (r) where score > 0)
        select item_id, rank, doc_id, score from o where rank <= 10
    """,
    "op13_product_code": code_sql(),
}
