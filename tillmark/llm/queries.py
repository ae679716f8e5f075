"""One query per operation, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.llm import binary, bpe, jaccard, lines, manifest, mixing, pages, quality, reputation, spelling, topk, toxicity, vectors
from tillmark.session import ship_package
from tillmark.sources.shared import new_folder


#: Rows that Spark sends to a Python worker at once, instead of 10,000: texts can be long.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    if spark.conf.get(BATCH[0]) == "10000":  # a session's own choice stays
        spark.conf.set(*BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-ids")
    binary.write_ids(table(spark, sf_dir, "documents"), folder, tokenizer_file("word_bpe_49k.json"), end_id=1)
    return binary.digests(spark, folder)


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.whole_numbers(F.col("embedding")).alias("vector"))
    return topk.top_k(rows, F.col("vec_id") % 20 == 0, k=20)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), n=5, percent=80)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "copy", "source", "lang", "n_chars", "text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return manifest.prove(table(spark, sf_dir, "documents"), tampered, manifest.ascii_lower(F.col("text")))


#: Rules on hosts and paths.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's path ends with the number of a document; its outcome is bad if that is labelled toxic or of low quality."""
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document"), bad.alias("bad"))
    judged = reputation.judge(table(spark, sf_dir, "pages"), outcomes, URL_RULES)
    return judged.withColumns({c: F.round(c, 9) for c in ("bad_share", "bound")})


def _crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes in DuckDB, bit by bit: -1 in the list stands for a shift."""
    codes = f"list_transform(range(strlen({text})), lambda i: [cast('0x' || substr(hex(encode({text})), 2 * i + 1, 2) as bigint), -1, -1, -1, -1, -1, -1, -1, -1])"
    step = "case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end"
    return f"xor(list_reduce(list_concat([4294967295::bigint], flatten({codes})), lambda a, x: {step}), 4294967295)"


def _field(column: str, value: str = "") -> str:
    text = f"cast({value or column} as varchar)"
    return f"case when {column} is null then '-' else strlen({text}) || ':' || {text} end"


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_ids": op2_token_ids,
    "op3_top_k": op3_top_k,
    "op4_main_text": op4_main_text,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality": op6_quality,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_near_vectors": op8_near_vectors,
    "op9_mix_sources": op9_mix_sources,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_url_filter": op13_url_filter,
}

#: What DuckDB makes of the same tables. The other operations are tested against brute force, see tests/llm.
ORACLES: dict[str, str] = {
    "op9_mix_sources": """
with recursive sizes as (select source, cast(sum(coalesce(length(text), 0)) as double) as size from documents group by source),
weighed as (select *, case when size > 0 then 1.0e0 else 0.0e0 end as weight from sizes),
totals as (select sum(weight) as weights, sum(size) as sizes from weighed),
rates as (select source, case when size > 0 then weight / weights * sizes / size else 0.0e0 end as rate from weighed, totals),
sums as (
    select source, rate, 0 as k, exp(-rate) as mass, exp(-rate) as total from rates
    union all
    select source, rate, k + 1, mass * rate / (k + 1), total + mass * rate / (k + 1) from sums
    where k < ceil(rate + 12 * sqrt(rate) + 20) - 1
),
drawn as (
    select *, cast(cast('0x' || substr(md5('17:count1:' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) as double) / 4503599627370496.0e0 as u
    from documents
),
counted as (
    select d.doc_id, d.source, d.lang, d.n_chars, d.text, count(*) as copies
    from drawn d join sums s on d.source is not distinct from s.source and s.total <= d.u
    group by all
)
select doc_id, cast(unnest(range(1, copies + 1)) as integer) as copy, source, lang, n_chars, text from counted
""",
    "op11_spelling_variants": f"""
with runs as (
    select doc_id, {_LOWER.format("unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+'))")} as run from documents
),
counted as (select coalesce(cast(doc_id as varchar), '') || ':' || run as named, run, count(*) as n from runs where length(run) >= 7 group by all),
hashed as (select run, n, {_crc32("named")} as h from counted),
typed as (
    select case when h % 31 = 0 then substr(run, 1, cast(h % length(run) as integer)) || substr(run, cast(h % length(run) as integer) + 2) else run end as word, n
    from hashed
),
words as (select word, cast(sum(n) as bigint) as n from typed where length(word) >= 7 group by word having sum(n) >= 2),
places as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
holes as (select word, n, i, substr(word, 1, cast(i as integer) - 1) || substr(word, cast(i as integer) + 1) as rest from places),
pairs as (
    select a.word, b.word as other, b.n as other_n from holes a join holes b on a.i = b.i and a.rest = b.rest and a.word <> b.word
    union select a.word, b.word, b.n from holes a join words b on a.rest = b.word
    union select b.word, a.word, a.n from holes a join words b on a.rest = b.word
),
best as (
    select w.word, w.n, count(p.other) as n_near, first(p.other order by p.other_n desc, p.other) as other, first(p.other_n order by p.other_n desc, p.other) as other_n
    from words w left join pairs p on p.word = w.word group by w.word, w.n
),
judged as (select word, n, n_near, case when other_n >= 10 * n then other end as form, case when other_n >= 10 * n then other_n end as form_n from best),
forms as (select word, form from judged where form is not null),
chains as (
    with recursive c as (
        select word, form as root from forms
        union all select c.word, f.form from c join forms f on f.word = c.root
    ) select word, root from c where root not in (select word from forms)
)
select j.word, j.form, coalesce(c.root, j.word) as root, j.n, j.n_near, j.form_n from judged j left join chains c on c.word = j.word
""",
    "op12_merkle_manifest": f"""
with recursive leaves as (
    select *, {_crc32("cast(doc_id as varchar)")} % 3 = 0 as tampered,
        sha256({" || ".join(_field(c) for c in manifest.COLUMNS)}) as leaf,
        sha256({" || ".join(_field(c, _LOWER.format("text") if c == "text" else "") for c in manifest.COLUMNS)}) as lowered
    from documents
),
sorted as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place from leaves),
trees as (
    select lang, 0 as level, list(leaf order by place) as nodes from sorted group by lang
    union all
    select lang, level + 1, list_transform(range((len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[8 * i + 1 : 8 * i + 8], ''))) from trees
    where len(nodes) > 1
),
subroots as (select lang, nodes[1] as subroot, row_number() over (order by lang nulls first) - 1 as place from trees where len(nodes) = 1),
tops as (
    select 0 as level, list(subroot order by place) as nodes from subroots
    union all
    select level + 1, list_transform(range((len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[8 * i + 1 : 8 * i + 8], ''))) from tops
    where len(nodes) > 1
),
climbed as (
    select d.doc_id, d.lang, d.leaf, d.place, d.place as at, 0 as level, case when d.tampered then d.lowered else d.leaf end as folded, '' as proof from sorted d
    union all
    select c.doc_id, c.lang, c.leaf, c.place, c.at // 8, c.level + 1,
        sha256(array_to_string(t.nodes[c.at - c.at % 8 + 1 : c.at], '') || c.folded || array_to_string(t.nodes[c.at + 2 : c.at - c.at % 8 + 8], '')),
        c.proof || array_to_string(t.nodes[c.at - c.at % 8 + 1 : c.at], '') || array_to_string(t.nodes[c.at + 2 : c.at - c.at % 8 + 8], '')
    from climbed c join trees t on t.lang is not distinct from c.lang and t.level = c.level
    where len(t.nodes) > 1
),
heights as (select lang, max(level) as level from trees group by lang),
below as (
    select c.doc_id, c.leaf, s.subroot, s.place as at, 0 as level, c.folded, c.proof
    from climbed c join heights h on h.lang is not distinct from c.lang and h.level = c.level
    join subroots s on s.lang is not distinct from c.lang
),
finished as (
    select * from below
    union all
    select f.doc_id, f.leaf, f.subroot, f.at // 8, f.level + 1,
        sha256(array_to_string(t.nodes[f.at - f.at % 8 + 1 : f.at], '') || f.folded || array_to_string(t.nodes[f.at + 2 : f.at - f.at % 8 + 8], '')),
        f.proof || array_to_string(t.nodes[f.at - f.at % 8 + 1 : f.at], '') || array_to_string(t.nodes[f.at + 2 : f.at - f.at % 8 + 8], '')
    from finished f join tops t on t.level = f.level
    where len(t.nodes) > 1
)
select f.doc_id, f.leaf, f.subroot, t.nodes[1] as root, sha256(f.proof) as proof_sha256, f.folded as folded_root, f.folded = t.nodes[1] as verified
from finished f join tops t on len(t.nodes) = 1 and t.level = f.level
""",
    "op13_url_filter": f"""
with cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
read as (select page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
named as (
    select *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$|[.]$', '') as name,
        try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:[.]html)?/?$', 1) as bigint) as document
    from read
),
parts as (
    select *, regexp_full_match(name, '[0-9]+([.][0-9]+){{3}}|\\[.*') as numbers, string_split(name, '.') as labels, array_to_string(string_split(name, '.')[-2:], '.') as last
    from named
),
cuts as (
    select *, case when numbers then name when last in {reputation.SUFFIXES} then array_to_string(labels[-3:], '.') else last end as domain,
        case when numbers then name when last in {reputation.SUFFIXES} then last else labels[-1] end as suffix
    from parts
),
outcomes as (select doc_id as document, count(*) as labels, sum(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels where doc_id is not null group by doc_id),
hosts as (
    select c.host, c.domain, c.suffix, cast(coalesce(sum(o.labels), 0) as double) as n, cast(coalesce(sum(o.bad), 0) as double) as bad
    from cuts c left join outcomes o on o.document = c.document group by c.host, c.domain, c.suffix
),
domains as (select suffix, domain, sum(n) as n, sum(bad) as bad from hosts group by suffix, domain),
suffixes as (select suffix, sum(n) as n, sum(bad) as bad from hosts group by suffix),
overall as (select (coalesce(sum(bad), 0) + {reputation.PRIOR}e0) / (coalesce(sum(n), 0) + 1) as m from hosts),
suffix_weight as (select {{weight}} as weight from (select n, bad, m from suffixes, overall)),
suffix_shares as (select suffix, (bad + weight * m) / (n + weight) as share from suffixes, overall, suffix_weight),
domain_weight as (select {{weight}} as weight from (select n, bad, share as m from domains join suffix_shares using (suffix))),
domain_shares as (select suffix, domain, (bad + weight * share) / (n + weight) as share from domains join suffix_shares using (suffix), domain_weight),
host_weight as (select {{weight}} as weight from (select n, bad, share as m from hosts join domain_shares using (suffix, domain))),
posterior as (select host, n + weight as size, (bad + weight * share) / (n + weight) as p from hosts join domain_shares using (suffix, domain), host_weight),
bounds as (select host, p, 1 / (1 + exp({reputation.BOUND_Z}e0 * sqrt(1 / (p * (1 - p) * (size + 1))) - ln(p / (1 - p)))) as bound from posterior),
ruled as (
    select page_id, host, path, case
        when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
        when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
        when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
        when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
        when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/'
    end as rule from read
)
select r.page_id, r.host, r.path, r.rule, case
        when r.rule in ('com/', 'www.example.com/en/') then 'allow' when r.rule is not null then 'block'
        when b.bound > {reputation.THRESHOLD}e0 then 'block' else 'allow' end as verdict,
    round(b.p, 9) as bad_share, round(b.bound, 9) as bound
from ruled r left join bounds b on b.host = r.host
""".replace("{weight}", "1 / greatest({0}e0, least({1}e0, coalesce(sum((bad - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), {1}e0))) - 1".format(*reputation.CORRELATION)),
}
