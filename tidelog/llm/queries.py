"""One query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, decontaminate, divergence, fingerprint, language, lm, neardup, negatives, pages, passages, privacy, secrets, substrings
from tidelog.llm.catalog import query
from tidelog.llm.common import fold, table

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op1_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), "doc_id", "text", RANK_FILE, public_tokenizers.PATTERN)


@query("op3_fingerprints")
def document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, folder, "documents"), "doc_id", "text")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op8_decontaminate",
    f"""WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
    b AS (SELECT item_id, ws, least(len(ws), 10) AS l FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
    win AS (SELECT DISTINCT item_id, l, array_to_string(ws[i : i + l - 1], ' ') AS phrase
            FROM (SELECT *, unnest(range(1, len(ws) - l + 2)) AS i FROM b)),
    hits AS (SELECT doc_id, i, p.l, item_id
             FROM (SELECT doc_id, i, l, array_to_string(ws[i : i + l - 1], ' ') AS phrase
                   FROM (SELECT d.*, x.l, unnest(range(1, len(ws) - x.l + 2)) AS i FROM d, (SELECT DISTINCT l FROM win) x)) p
             JOIN win ON win.l = p.l AND win.phrase = p.phrase),
    hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS place FROM hits) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
)
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "benchmark"), "item_id", "text")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op2_html_extraction")
def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(table(spark, folder, "pages"), "page_id", "url", "html")


@query("op7_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.train(docs, "text", "lang", F.coalesce(fold("doc_id", 3) != 1, F.lit(True)))
    found = language.predict(docs, "doc_id", "text", model)
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query(
    "op4_minhash_dedup",
    r"""WITH RECURSIVE w AS (
      SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws
      FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS shingle
          FROM (SELECT *, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    link AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL)
             JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
    reach AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN link ON a = seen),
    least AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)""",
)
def minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, folder, "documents"), "doc_id", "text", size=4, percent=80)
    return found.drop("digest")


@query("op5_secret_scan")
def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"), "doc_id", "text")
    names = F.array(*[F.lit(k) for k in secrets.KINDS])
    spans = F.zip_with(
        F.zip_with("starts", "ends", lambda s, e: F.concat_ws(":", s.cast("string"), e.cast("string"))),
        "kinds", lambda place, kind: F.concat_ws(":", F.get(names, kind), place),
    )
    found = found.withColumn("named", spans)
    counted = [F.expr(f"CAST(size(filter(kinds, k -> k = {n})) AS BIGINT) AS n_{secrets.KINDS[n]}") for n in range(3)]
    base = F.array_join(F.filter("named", lambda s: ~s.startswith("model:")), ",")
    return found.select("doc_id", *counted, F.sha2(base, 256).alias("base_sha256"), F.array_join("named", ",").alias("spans"))


@query("op10_lm_scoring")
def lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents"), "doc_id", "text", fold("doc_id", 5) != 1)


@query("op6_substring_removal")
def substring_removal(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, folder, "documents"), "doc_id", "text", size=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_passage_dedup")
def passage_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = passages.repeated_passages(table(spark, folder, "documents"), "doc_id", "text", length=50, size=5, percent=80)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_repeated", F.size("spans").cast("long").alias("n_spans"), "n_links", "component_id", spans.alias("spans"))


@query(
    "op11_hard_negatives",
    """WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                     list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
              FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    a AS (SELECT * FROM v WHERE vec_id % 100 = 0),
    s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, a.label AS al, v.r, v.vec_id, v.label,
                 CAST(list_sum(list_transform(list_zip(a.q, v.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM a JOIN v ON a.r <> v.r),
    pos AS (SELECT * FROM s WHERE label = al QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) <= 5),
    neg AS (SELECT pos.anchor_id, pos.vec_id AS positive_id, pos.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                   row_number() OVER (PARTITION BY pos.ar, pos.r ORDER BY s.score DESC, s.vec_id, s.r) AS rank
            FROM pos JOIN s ON s.ar = pos.ar AND s.label <> s.al AND 30 * pos.score <= 100 * s.score AND 100 * s.score <= 90 * pos.score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10""",
)
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, "vec_id", "embedding", "label", F.col("vec_id") % 100 == 0)


@query("op12_pii")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = privacy.scan(table(spark, folder, "documents"), "doc_id", "text")
    names = F.array(*[F.lit(k) for k in privacy.KINDS])
    spans = F.transform(
        F.arrays_zip("kinds", "starts", "ends", "added"),
        lambda s: F.struct(F.concat_ws(":", F.get(names, s["kinds"]), s["starts"].cast("string"), s["ends"].cast("string")).alias("named"), s["kinds"].alias("kind"), s["added"].alias("added")),
    )
    found = found.select("doc_id", spans.alias("all"), F.filter(spans, lambda s: ~s["added"]).alias("base"))
    counted = [F.expr(f"CAST(size(filter(base, s -> s.kind = {n})) AS BIGINT) AS n_{name}") for n, name in enumerate(privacy.KINDS)]
    added = (F.size("all") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *counted, F.sha2(F.array_join("base.named", ","), 256).alias("base_sha256"), F.array_join("all.named", ",").alias("spans"), added)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    "op13_source_divergence",
    f"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS ws FROM documents),
    t AS (SELECT id, lang, source, unnest(ws) AS term FROM d),
    kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
    n AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    grp AS (SELECT DISTINCT lang, source FROM d),
    cell AS (SELECT grp.*, kept.term, coalesce(n.n, 0) AS n FROM grp JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
    size AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
    share AS (SELECT cell.*, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p,
                     1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
              FROM cell JOIN size USING (lang)),
    pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
             FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
             LEFT JOIN share x ON x.lang = a.lang AND x.source = a.source
             LEFT JOIN share y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
    term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM share WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
               FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
)
def source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"), "text", "lang", "source")
