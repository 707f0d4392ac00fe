"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import alignment, ann, bpe, chat, decontaminate, exact_dedup, lm, mixing, negatives, quality, simhash, toxicity, urls
from chronolith.llm.common import fold, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), labels, {"clean": 0.92, "rough": 0.06, "toxic": 0.02})


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, toxicity.training_labels(labels))
    return toxicity.score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, quality.training_labels(labels))
    return quality.score(docs, model)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 50 = 0"), k=5)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.default_tokenizer(spark))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, training = lm.split_by_fold(table(spark, sf_dir, "documents"))
    seen, unseen = lm.cut(training), lm.cut(docs.where("held_out"), part=1)
    model = lm.fit(seen)
    scored = lm.score_blocks(seen.union(unseen), model).withColumn("train_tokens", F.lit(model.train_tokens).cast("long"))
    return scored.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urls.SITE_RULES + urls.PATTERN_RULES)
    site = F.col("rule").isin([r.name for r in urls.SITE_RULES])
    return judged.select("page_id", "host", "path", F.when(site, F.col("rule")).alias("rule"), "verdict", F.when(~site, F.col("rule")).alias("pattern"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = "(-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]')"
    planted = spark.sql(f"SELECT * FROM VALUES {extra} AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digests(chat.format_windows(turns))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), *alignment.default_tokenizers(spark))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("id") % 100 == 0)


def queries() -> dict:
    return {
        "op1_mixing": op1_mixing,
        "op2_toxicity": op2_toxicity,
        "op3_quality": op3_quality,
        "op4_simhash": op4_simhash,
        "op5_ann": op5_ann,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_url_filter": op7_url_filter,
        "op8_bpe": op8_bpe,
        "op9_lm": op9_lm,
        "op10_chat": op10_chat,
        "op11_alignment": op11_alignment,
        "op12_decontaminate": op12_decontaminate,
        "op13_hard_negatives": op13_hard_negatives,
    }


def _url_sql() -> str:
    """Every rule on every page: no index."""
    cut = "substr(url, instr(url, '://') + 3)"
    rest = lambda pattern: f"CASE WHEN contains(url, '://') THEN regexp_extract({cut}, '{pattern}', 1) ELSE '' END"
    sites = ", ".join(f"('{r.name.split('/')[0]}', '/{r.name.split('/', 1)[1]}', '{r.verdict}')" for r in urls.SITE_RULES)
    words = ", ".join(f"('{r.name}', '{r.name.replace('-', '[-_.]?')}')" for r in urls.PATTERN_RULES)
    return f"""
        WITH parts AS (SELECT page_id, translate({rest("^([^/?#]*)")}, '{UPPER}', '{LOWER}') AS host, {rest("^[^/?#]*([^?#]*)")} AS path FROM pages),
        sites(h, p, v) AS (VALUES {sites}), words(w, x) AS (VALUES {words}),
        fits AS (
            SELECT host, path, (SELECT max(struct_pack(n := length(h || p), rule := h || p, verdict := v)) FROM sites WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS site,
                   (SELECT min(struct_pack(n := -length(w), word := w)) FROM words WHERE regexp_matches(host || path, '(?i)(?:^|[^0-9a-z])' || x || '(?:$|[^0-9a-z])')) AS found
            FROM (SELECT DISTINCT host, path FROM parts)
        )
        SELECT page_id, host, path, site.rule AS rule, CASE WHEN site IS NOT NULL THEN site.verdict WHEN found IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
               CASE WHEN site IS NULL THEN found.word END AS pattern
        FROM parts JOIN fits USING (host, path)
    """


def _chat_sql() -> str:
    """The same windows from plain window functions over whole conversations."""
    said = "'</s>[INST] ok [/INST]'"
    marks = len(chat.OPEN) + len(chat.MIDDLE) + len(chat.CLOSE)
    grown = lambda c: f"(length({c}) + 4 * (length({c}) - length(replace({c}, '&', ''))) + 3 * (length({c}) - length(replace({c}, '<', ''))) + 4 * (length({c}) - length(replace({c}, '[', ''))))"
    return f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x
            FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', {said}), (-1, 1, 'assistant', {said})))
        ),
        numbered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x) AS number,
                   len(regexp_extract_all(x, '{chat.TOKEN}')) + {chat.MARK_TOKENS} AS tokens, {marks} + {grown("r")} + {grown("x")} AS chars
            FROM turns
        ),
        headed AS (
            SELECT *, coalesce(max(CASE WHEN number = 1 AND r = 'system' AND tokens <= 512 THEN tokens END) OVER (PARTITION BY conv_id), 0) AS head,
                   coalesce(max(CASE WHEN number = 1 AND r = 'system' AND tokens <= 512 THEN chars END) OVER (PARTITION BY conv_id), 0) AS head_chars,
                   number = 1 AND r = 'system' AND tokens <= 512 AS is_head
            FROM numbered
        ),
        placed AS (
            SELECT *, coalesce(sum(CASE WHEN is_head THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                   1024 - head AS room
            FROM headed
        ),
        celled AS (SELECT *, before + CASE WHEN is_head THEN 0 ELSE tokens END AS after, before // room AS cell FROM placed),
        crossing AS (SELECT *, after > (cell + 1) * room AS crosses FROM celled),
        begun AS (SELECT *, min(CASE WHEN NOT crosses THEN before END) OVER (PARTITION BY conv_id, cell) AS start FROM crossing),
        spanned AS (SELECT *, crosses AND NOT coalesce(after - start <= room, false) AS own FROM begun),
        spans AS (
            SELECT conv_id, cell, own, any_value(room) AS room, any_value(head_chars) AS head_chars, min(number) AS first, max(after) AS last, sum(chars) AS chars
            FROM spanned GROUP BY ALL
        ),
        history AS (
            SELECT s.conv_id, sum(h.chars) AS chars
            FROM spans s JOIN spanned h ON h.conv_id IS NOT DISTINCT FROM s.conv_id AND h.number BETWEEN s.first - 2 AND s.first - 1
            WHERE NOT h.is_head AND s.last - h.before <= s.room GROUP BY s.conv_id
        ),
        formatted AS (SELECT conv_id, sum(chars) + sum(CASE WHEN first > 1 THEN head_chars ELSE 0 END) AS chars FROM spans GROUP BY conv_id),
        digests AS (
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY number)) AS turns_sha256,
                   coalesce(string_agg(CASE WHEN r = 'assistant' THEN x END, '' ORDER BY number), '') AS loss
            FROM numbered GROUP BY conv_id
        )
        SELECT d.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(f.chars + coalesce(h.chars, 0) AS BIGINT) AS formatted_chars
        FROM digests d JOIN formatted f ON d.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN history h ON d.conv_id IS NOT DISTINCT FROM h.conv_id
    """


def _decontaminate_sql() -> str:
    """Every window of every document as text, joined to those of the items."""
    words = lambda name, key: f"SELECT {key}, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM {name}"
    return f"""
        WITH d AS ({words("documents", "row_number() OVER () AS r, doc_id")}), b AS ({words("benchmark", "coalesce(CAST(item_id AS VARCHAR), '') AS item")}),
        grams AS (
            SELECT DISTINCT n, array_to_string(w[p : p + n - 1], ' ') AS gram, item
            FROM (SELECT item, w, least(len(w), {decontaminate.WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {decontaminate.WINDOW}) + 2)) AS p FROM b WHERE len(w) > 0)
        ),
        placed AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
        runs AS (SELECT r, p, list(word) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {decontaminate.WINDOW - 1} FOLLOWING) AS run FROM placed),
        cut AS (SELECT r, p, n, array_to_string(run[1 : n], ' ') AS gram FROM runs, (SELECT DISTINCT n FROM grams) WHERE len(run) >= n),
        hits AS (SELECT r, p, n, item FROM cut JOIN grams USING (n, gram)),
        hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
    """


def _negatives_sql() -> str:
    """Every anchor against every row, by components as they are."""
    return """
        WITH fine AS (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        pairs AS (
            SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
            FROM fine a JOIN fine r ON a.id <> r.id WHERE a.id % 100 = 0
        ),
        positive AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM positive JOIN pairs USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
    """


def oracle_sql() -> dict[str, str]:
    return {
        "op12_decontaminate": _decontaminate_sql(),
        "op13_hard_negatives": _negatives_sql(),
        "op7_url_filter": _url_sql(),
        "op10_chat": _chat_sql(),
        "op6_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
        """,
    }
