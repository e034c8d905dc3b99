"""The registered queries of the package and their SQL texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.chatformat import chat_windows, read_windows
from pulsegrid.llm.collocations import collocations
from pulsegrid.llm.common import table
from pulsegrid.llm.decontam import contamination
from pulsegrid.llm.idstore import token_files
from pulsegrid.llm.jaccard import near_duplicates
from pulsegrid.llm.linededup import drop_common_lines
from pulsegrid.llm.mixing import mix
from pulsegrid.llm.phrases import remove_repeats
from pulsegrid.llm.pii import BASE, KINDS, pii_spans
from pulsegrid.llm.pivots import near_vectors
from pulsegrid.llm.quality import quality, train
from pulsegrid.llm.repair import audits, damaged, repair
from pulsegrid.llm.tokencount import count_sections

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "op1_decontaminate",
    r"""
    WITH words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
    items AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
    grams AS (SELECT DISTINCT item_id, list_slice(w, i, i + least(len(w), 10) - 1) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
    lengths AS (SELECT DISTINCT len(g) AS k FROM grams),
    tries AS (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, lengths)),
    hits AS (SELECT doc_id, i, k, item_id FROM tries JOIN grams USING (g)),
    n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
    found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM words LEFT JOIN n_hit USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


@query("op2_find_pii")
def op2_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:BASE]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


@query("op3_chat_format")
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # Conversation -1 says the template's own marks.
    marks = "<|im_end|><|im_start|>assistant ok"
    one = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marks).alias("text"))
    read = read_windows(chat_windows(turns.unionByName(one)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read.select("conv_id", "major", "minor", said.alias("said"), F.size("turns").alias("n"), F.array_join("losses", "").alias("loss"), "chars")
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("major", "minor", "said", "loss"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join("w.loss", "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join("w.said", ""), 256).alias("turns_sha256"), F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("bigint"))


@query("op4_jaccard_join")
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class and the number of other documents at a Jaccard similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links")


@query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept")


@query(
    "op6_line_dedup",
    r"""
    WITH lines AS (SELECT doc_id, i, l[i] AS line, translate(regexp_replace(l[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
    common AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (common.key IS NOT NULL) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (common.key IS NULL), '')) AS kept_sha256
    FROM lines LEFT JOIN common ON lines.key = common.key GROUP BY doc_id
    """,
)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_mix_sources")
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_token_ids")
def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path())


@query(
    "op9_substring_dedup",
    r"""
    WITH words AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    windows AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words)),
    twice AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
    gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM windows SEMI JOIN twice USING (g)) GROUP BY doc_id),
    flat AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM words)),
    marked AS (SELECT flat.*, x.p IS NOT NULL AS gone FROM flat LEFT JOIN (SELECT doc_id, unnest(gone) AS p FROM gone) x USING (doc_id, p)),
    kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM words LEFT JOIN kept USING (doc_id)
    """,
)
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and of each of its sentences and lines."""
    counted = count_sections(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.tiktoken"))
    return counted.select("doc_id", "n_tokens", "n_sections", "n_crossing", F.array_join(F.col("section_tokens").cast("array<string>"), ",").alias("section_tokens"))


@query(
    "op11_collocations",
    r"""
    WITH pieces AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
    totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
    grams AS (SELECT lang, list_slice(w, i, i + k - 1) AS g, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3), (4)) t(k)) GROUP BY ALL),
    phrases AS (SELECT lang, g, f AS a FROM grams WHERE len(g) > 1 AND f >= 30),
    cuts AS (SELECT p.lang, p.g, a, k, x.f AS l, y.f AS r, CAST(a AS HUGEINT) * 2000000 // (x.f + y.f) AS score FROM (SELECT *, unnest(range(1, len(g))) AS k FROM phrases) p
        JOIN grams x ON x.lang = p.lang AND x.g = p.g[1:k] JOIN grams y ON y.lang = p.lang AND y.g = p.g[k + 1:]),
    scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
    inside AS (SELECT lang, list_slice(g, i, i + k - 1) AS g, max(a) AS longer FROM (SELECT lang, g, a, k, unnest(range(1, len(g) - k + 2)) AS i FROM phrases, (VALUES (2), (3)) t(k) WHERE k < len(g)) GROUP BY ALL),
    ranked AS (SELECT s.lang, array_to_string(s.g, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, array_to_string(s.g, ' ')) AS rank
        FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.g = s.g WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT))
    SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


@query(
    "op12_near_vectors",
    r"""
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    good AS (SELECT row_number() OVER () AS n, vec_id, label, e FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS (SELECT a.n AS a, b.n AS b, b.vec_id AS id FROM good a JOIN good b ON a.label = b.label AND a.n <> b.n AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
    reached AS (SELECT a, b, id FROM links UNION SELECT r.a, l.b, l.id FROM reached r JOIN links l ON r.b = l.a)
    SELECT vec_id, coalesce(k, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
    FROM good LEFT JOIN (SELECT a, count(*) AS k FROM links GROUP BY a) x ON x.a = n LEFT JOIN (SELECT a, min(id) AS low FROM reached GROUP BY a) y ON y.a = n
    UNION ALL SELECT vec_id, 0, vec_id, true FROM v WHERE NOT coalesce(label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0, false)
    """,
)
def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _repair_sql() -> str:
    """The same dynamic program over all conversations at once; a state is its cost in 12 digits and then its edits, so the least string is the best."""

    def add(state: str, edit: str, cost: str) -> str:
        return f"(lpad(CAST(CAST({state}[1:12] AS BIGINT) + {cost} AS VARCHAR), 12, '0') || {state}[13:] || '{edit}')"

    return rf"""
    WITH RECURSIVE keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    hashed AS (SELECT *, xor(4294967295, list_reduce(list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda crc, byte:
        list_reduce([CAST(0 AS BIGINT), 1, 2, 3, 4, 5, 6, 7], lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, byte)), CAST(4294967295 AS BIGINT))) % 20 AS how FROM keyed),
    hurt AS (SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, unnest(range(CASE how WHEN 3 THEN 2 ELSE 1 END)) AS copy,
        CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text FROM hashed WHERE how > 0),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, left(role, 1) AS c,
        regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending FROM hurt),
    judged AS (SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
    best AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000000000' AS b0, CAST(NULL AS VARCHAR) AS b1, CAST(NULL AS VARCHAR) AS b2, CAST(NULL AS VARCHAR) AS b3 FROM judged
        UNION ALL SELECT conv_id, i, {add("b0", "D", "4")},
            least({add("b1", "D", "4")}, CASE WHEN NOT must AND c = 's' THEN {add("b0", "K", "stay")} END),
            least({add("u", "D", "4")}, CASE WHEN NOT must THEN least({add("b0", "R", "3 + stay")}, {add("b1", "R", "3 + stay")}, {add("a", "R", "3 + stay")}) END,
                CASE WHEN NOT must AND c = 'u' THEN least({add("b0", "K", "stay")}, {add("b1", "K", "stay")}, {add("a", "K", "stay")}) END),
            least({add("a", "D", "4")}, CASE WHEN NOT must THEN {add("u", "R", "3 + stay")} END, CASE WHEN NOT must AND c = 'a' THEN {add("u", "K", "stay")} END)
        FROM (SELECT *, least(b3, {add("u", "I", "3")}) AS a FROM (SELECT j.conv_id, j.i, b0, b1, b3, c, fault IN ('blank', 'duplicate') AS must, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS stay,
            least(b2, {add("b0", "I", "3")}, {add("b1", "I", "3")}, {add("b3", "I", "3")}) AS u FROM best JOIN judged j ON j.conv_id IS NOT DISTINCT FROM best.conv_id AND j.i = best.i + 1))),
    ended AS (SELECT conv_id, least(b0, b3, {add("b2", "I", "3")}, {add("b1", "II", "6")}) AS s FROM best
        JOIN (SELECT conv_id AS last_conv, max(i) AS last_i FROM judged GROUP BY 1) ON last_conv IS NOT DISTINCT FROM conv_id AND i = last_i),
    steps AS (SELECT conv_id, p, s[p] AS edit FROM (SELECT conv_id, s, unnest(range(13, len(s) + 1)) AS p FROM ended)),
    placed AS (SELECT *, sum(CAST(edit <> 'I' AS INT)) OVER w AS i, sum(CAST(edit <> 'D' AS INT)) OVER w AS o FROM steps WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
    rebuilt AS (SELECT x.conv_id, p, edit, o, c, role, text, max(CAST(edit = 'K' AND c = 's' AS INT)) OVER (PARTITION BY x.conv_id) AS head
        FROM placed x LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM x.conv_id AND j.i = x.i AND edit <> 'I' WHERE edit <> 'D'),
    lines AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - head) % 2 = 1 THEN 'user' ELSE 'assistant' END
        || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS said FROM rebuilt GROUP BY conv_id),
    figures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
    SELECT v.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        CAST(coalesce(s[1:12], '0') AS BIGINT) AS cost, coalesce(s[13:], '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM v.conv_id
    """


@query("op13_repair_conversations", _repair_sql())
def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hurt = damaged(turns)
    return audits(turns, hurt, *repair(hurt))
