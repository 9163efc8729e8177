"""The registered queries of this subpackage and their SQL twins. The pipeline is registered here too."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from palisade.llm import archives, cotraining, decontaminate, lines, mixing, pii, rules, search, secrets, simhash, tokens, tries, urls
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
TWINS: dict[str, str] = {}


def query(twin: str | None = None) -> Callable[[Build], Build]:
    def keep(build: Build) -> Build:
        QUERIES[build.__name__] = build
        if twin is not None:
            TWINS[build.__name__] = twin
        return build

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, as counts, a digest of the pattern spans and all spans."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


@query()
def op2_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the packages written for the table."""
    return archives.round_trip(table(spark, sf_dir, "pages"))


@query()
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document, its source's size and target, and the words that the mix takes of it."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query()
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibrated scores of every document, by its words, by its metadata and by both, and whether it is kept."""
    found = cotraining.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("row.doc_id", "scores.*").withColumn("kept", F.col("score") >= cotraining.KEEP_AT)


@query()
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.clusters(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_BLANK = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
LINE_TWIN = f"""
with pieces as (select doc_id, string_split(coalesce(text, ''), chr(10)) as p from documents),
lines as (select doc_id, i, p[i + 1] as line from (select doc_id, p, unnest(range(0, len(p))) as i from pieces)),
full_ as (select doc_id, i, trim(line, {_BLANK}) as t from lines where trim(line, {_BLANK}) <> ''),
windows as (select doc_id, i, lead(i, 2) over d as last, t, lead(t, 1) over d as t1, lead(t, 2) over d as t2 from full_ window d as (partition by doc_id order by i)),
ranked as (select *, row_number() over (partition by t, t1, t2 order by doc_id, i) as n from windows where last is not null),
gone as (select distinct doc_id, unnest(range(i, last + 1)) as i from ranked where n > 1),
kept as (select doc_id, string_agg(line, chr(10) order by i) as text, count(*) as n from lines anti join gone using (doc_id, i) group by 1)
select doc_id, coalesce(k.text, '') as text, cast(case when coalesce(d.text, '') = '' then 0 else len(p.p) end as bigint) as n_lines,
  cast(len(p.p) - coalesce(k.n, 0) as bigint) as n_removed
from documents d join pieces p using (doc_id) left join kept k using (doc_id)"""


@query(LINE_TWIN)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every document without passages that stand elsewhere before, and the number of lines removed."""
    done = lines.deduplicated(table(spark, sf_dir, "documents"))
    return done.select("row.doc_id", F.coalesce("text", F.lit("")).alias("text"), "n_lines", "n_removed")


URL_RULES = (
    urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/"),
)
# Hosts with one of these words between dots or hyphens are listed.
LISTED_HOST = r"(^|[.-])(adult|ads|bets|casino|pills|spam)([.-]|$)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = "when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h}{p}'"
URL_TWIN = f"""
with parts as (
  select page_id, coalesce({_LOWER.format("regexp_extract(rest, '^[^/?#]*')")}, '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages)),
ruled as (
  select *, case {" ".join(_FITS.format(h=r.host, p=r.path) for r in sorted(URL_RULES, key=lambda r: -len(r.text)))} end as rule from parts)
select page_id, host, path, rule,
  case {" ".join(f"when rule = '{r.text}' then '{r.verdict}'" for r in URL_RULES)}
    when regexp_matches(host, '{LISTED_HOST}') then 'block' else 'allow' end as verdict
from ruled"""


@query(URL_TWIN)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, F.col("host").rlike(LISTED_HOST))


@query()
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, as counts, a digest of the pattern spans and all spans."""
    found = pii.find_personal(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


@query()
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, whether the base rules reject it, and the verdict of the learned list."""
    judged = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("rule").alias("rejected_by"))


_ITEM_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
LEAK_TWIN = f"""
with items as (select item_id, {_ITEM_WORDS} as w from benchmark),
grams as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as gram
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from items where len(w) > 0)),
docs as (select doc_id, {_ITEM_WORDS} as w from documents),
places as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as gram
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, (select distinct n from grams))),
hits as (select doc_id, i, p.n, item_id from places p join grams g on p.n = g.n and p.gram = g.gram),
words as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + n)) as pos from hits) group by 1),
found as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join words using (doc_id) left join found using (doc_id)"""


@query(LEAK_TWIN)
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_CRC_STEP = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
_CRC_TABLE = "range(256)"
for _ in range(8):
    _CRC_TABLE = f"list_transform({_CRC_TABLE}, lambda c: {_CRC_STEP})"
_CRC = "xor(list_reduce(list_transform(string_split(cast(conv_id as varchar), ''), lambda s: cast(ascii(s) as bigint)), lambda r, b: xor(r >> 8, t[(xor(r, b) & 255) + 1]), 4294967295), 4294967295)"
TRIE_TWIN = f"""
with crc as (select {_CRC_TABLE} as t),
own as (
  select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as turns
  from conversations where conv_id is not null group by 1),
heads as (select conv_id, turns, {_CRC} % 6 as h from own, crc),
rebuilt as (
  select o.conv_id, list_concat(coalesce(b.turns[1:h], []), o.turns[h + 1:]) as turns from heads o left join own b on b.conv_id = o.conv_id - o.conv_id % 100),
prefixes as (select conv_id, d, turns[1:d] as path, len(turns) = d as ends from (select conv_id, turns, unnest(range(len(turns) + 1)) as d from rebuilt)),
named as (select *, min(conv_id) over (partition by d, path) as node from prefixes),
nodes as (
  select node, d, count(*) as n_convs, coalesce(len(any_value(path)[d].text), 0) as chars,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '')) as ends_sha256
  from named group by 1, 2),
up as (select n.node, n.d, p.node as parent from nodes n left join named p on p.conv_id = n.node and p.d = n.d - 1),
children as (select parent as node, d - 1 as d, count(*) as n from up where d > 0 group by 1, 2),
subtree as (
  select a.node, a.d, count(*) filter (coalesce(c.n, 0) = 0) as n_leaves, sum((n.n_convs - 1) * n.chars) as saved
  from nodes n join named a on a.conv_id = n.node and a.d <= n.d left join children c on c.node = n.node and c.d = n.d group by 1, 2)
select n.node as conv_id, n.d as depth, u.parent as parent_conv_id, n.n_convs, cast(coalesce(c.n, 0) as bigint) as n_children,
  cast(s.n_leaves as bigint) as n_leaves, cast(s.saved as bigint) as saved_tokens, n.ends_sha256
from nodes n join up u using (node, d) join subtree s using (node, d) left join children c using (node, d)"""


@query(TRIE_TWIN)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    nodes = tries.prefix_trie(tries.rebuilt(table(spark, sf_dir, "conversations")))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@query()
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more tokens than a context of 512."""
    import public_tokenizers

    vocabulary = tokens.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    counted = table(spark, sf_dir, "documents").select("doc_id", tokens.token_counts(F.col("text"), vocabulary).alias("counts"))
    return counted.select("doc_id", "counts.n_bytes", "counts.n_tokens", (F.col("counts.n_tokens") > 512).alias("over_limit"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SEARCH_TWIN = f"""
with items as (select item_id, term, count(*) as times from (select item_id, unnest({_TERMS}) as term from benchmark) group by 1, 2),
docs as (select row_number() over () as row, doc_id, {_TERMS} as w from documents),
sizes as (select row, doc_id, len(w) as n from docs where len(w) > 0),
held as (
  select row, term, count(*) as tf from (select row, unnest(w) as term from docs) where term in (select term from items) group by 1, 2),
total as (select count(*) as big_n, cast(sum(n) as bigint) as big_l from sizes),
weights as (select term, cast(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) as bigint) as w
  from (select term, count(*) as df from held group by 1), total),
scored as (
  select i.item_id, s.doc_id, cast(sum(i.times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) as bigint) as score
  from held join items i using (term) join weights using (term) join sizes s using (row), total group by i.item_id, s.row, s.doc_id),
ranked as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as int) as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10"""


@query(SEARCH_TWIN)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every item."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["pipeline"] = corpus_pipeline.run
