"""The operators as queries over the given tables, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.llm import decontaminate, exact, licenses, merkle, multi_index, packing, quotes, simhash, spellings, sql, substrings, toxicity, urls, variable_packing
from tallywell.llm.common import table
from tallywell.session import literal_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function under its name."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if oracle:
            SQL[run.__name__] = oracle
        return run

    return register


@query()
def op1_token_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Token matrices of all documents, as digests of their rows."""
    packed = packing.pack(table(spark, folder, "documents"), 2048)
    return packed.select("shard", "row", "doc_ids", "pieces", "cu_seqlens", F.element_at("cu_seqlens", -1).alias("n_tokens"),
                         F.sha2("input_ids", 256).alias("ids_sha256"), F.sha2("position_ids", 256).alias("positions_sha256"))


@query()
def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents linked when their three-word shingles overlap by 85 percent, and the component of each."""
    return multi_index.near_duplicates(table(spark, folder, "documents"), size=3, similarity=0.85)


@query()
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents and benchmark items that BM25 finds in a passage, with the overlap of question and answer."""
    return decontaminate.contaminated_pairs(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM d WINDOW same AS (PARTITION BY text_sha256)""")
def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The table as three arriving batches: each against the snapshots before it, and within itself."""
    return exact.mark_duplicates(exact.arrivals(table(spark, folder, "documents"), 3))


@query()
def op5_variable_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of 512 to 8,192 ids that hold all documents."""
    return variable_packing.pack(table(spark, folder, "documents"))


@query()
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents by a model that saw the labels of two thirds."""
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit_model(docs, table(spark, folder, "labels").select("doc_id", "toxic")))


@query()
def op7_quote_linking(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations sent as mails with nested quotes, linked and cleaned again."""
    turns = table(spark, folder, "conversations").selectExpr("conv_id AS conversation", "turn AS position", "text")
    ordered = quotes.reply_order(quotes.with_quotes(turns))
    return ordered.selectExpr("conversation AS conv_id", "position AS turn", "parent", "root_position AS root", "depth", "n_quotes",
                              "n_linked", "sha2(clean_text, 256) AS clean_sha256")


@query()
def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and statements in all documents."""
    return licenses.scan(table(spark, folder, "documents"))


# The rules of the contract, and hosts that are blocked where no rule of the contract fits.
URL_RULES = [("net", "/", "block", 1), ("example.net", "/en/", "allow", 1), ("example.com", "/de/", "block", 1), ("org", "/fr/", "allow", 1),
             ("spam-farm.example.com", "", "block", 0), ("spam-farm.example.net", "", "block", 0), ("spam-farm.example.org", "", "block", 0),
             ("cheap-pills.example.com", "", "block", 0), ("cheap-pills.example.net", "", "block", 0), ("cheap-pills.example.org", "", "block", 0)]


@query("""
WITH r(h, p, v, c) AS (VALUES """ + ", ".join(f"('{h}', '{p}', '{v}', {c})" for h, p, v, c in URL_RULES) + """),
rest AS (SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) END AS after FROM pages),
parts AS (SELECT row_number() OVER () AS n, page_id,
  coalesce(translate(regexp_extract(after, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(after, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
fits AS (SELECT n, max((c, length(h) + length(p), length(h), v, h || p)) AS best FROM parts
  JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, CASE WHEN best[1] = 1 THEN best[5] END AS rule, coalesce(best[4], 'allow') AS verdict
FROM parts LEFT JOIN fits USING (n)""")
def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """All pages under the rules of the contract, then under a list of blocked hosts."""
    rules = literal_table(spark, "host string, path string, verdict string, precedence int", URL_RULES)
    judged = urls.judge(table(spark, folder, "pages"), rules)
    return judged.select("page_id", "host", "path", F.when(F.col("precedence") == 1, F.concat("rule_host", "rule_path")).alias("rule"), "verdict")


@query("""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM placed),
firsts AS (SELECT h, min(doc_id) AS first_id FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM windows JOIN firsts USING (h), range(13) AS r(k) WHERE first_id < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
         FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""")
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words inside 13-word passages that an earlier document has too, removed."""
    return substrings.remove_repeats(table(spark, folder, "documents"), 13).drop("kept_text")


@query(sql.merkle())
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Digest, proof and root of every document; of half of them the text lost its line breaks since."""
    docs = table(spark, folder, "documents")
    return merkle.manifest(docs, merkle.without_line_breaks_in_half(docs))


@query()
def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash fingerprints of all documents, and the component of those that chains of four bits or fewer connect."""
    return simhash.near_duplicates(table(spark, folder, "documents"), size=4, distance=4).drop("kept")


@query(sql.spellings())
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents, of which some lost a letter, with their most frequent neighbour and where that leads."""
    return spellings.grouped(table(spark, folder, "documents"), least_length=7, least_count=2, every=31, ratio=10)
