"""The operators' queries over the verification tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, class_lm, decontaminate, embedding_dedup, importance, language_id, near_dedup, pieces, prefix_trie, suffix_dedup, token_counts, topk_search, toxicity
from ._common import remainder

LENGTH, NGRAM, LIMIT = 200, 10, 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), NGRAM)
    return out.drop("items")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=LIMIT)


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(remainder(F.col("doc_id"), 3) != 1))
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = chat_format.canonical_turns(own.unionByName(more))
    return chat_format.read_back(chat_format.format_turns(turns))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2, similarity="0.8")
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = remainder(F.col("doc_id"), 4)
    model = language_id.train(docs.where(fold != 2))
    out = language_id.identify(docs, model)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.class_lm(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.substring_digests(table(spark, sf_dir, "documents"), LENGTH)


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.rebuilt(prefix_trie.ordered(table(spark, sf_dir, "conversations")))
    return prefix_trie.trie(turns).drop(*prefix_trie.KEY)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10000, percent=10, min_words=20, seed=2024)


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_token_counts, op3_topk_search, op4_toxicity, op5_chat_formatting, op6_near_dedup, op7_language_id, op8_class_lm, op9_sentencepiece, op10_suffix_dedup, op11_embedding_near_dedup, op12_prefix_trie, op13_importance_resampling)}


WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
PIECES = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"



def crc32_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, half a byte at a time by the polynomial's table."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    half = lambda at: f"instr('0123456789ABCDEF', substr(hex(encode({text})), {at}, 1)) - 1"
    halves = f"flatten(list_transform(range(1, 1 + octet_length(encode({text}))), lambda i: [CAST({half('2 * i')} AS UBIGINT), CAST({half('2 * i - 1')} AS UBIGINT)]))"
    step = f"lambda c, n: xor(c >> 4, CAST({table} AS UBIGINT[])[CAST(xor(c, n) & 15 AS INTEGER) + 1])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {halves}), {step}), CAST(4294967295 AS UBIGINT))"


SQL = {
    "op1_decontamination": f"""
        WITH b AS (SELECT item_id, {WORDS.format("text")} AS ws FROM benchmark WHERE text IS NOT NULL),
        bw AS (SELECT DISTINCT item_id, list_slice(ws, i + 1, i + least(len(ws), 10)) AS win
               FROM (SELECT item_id, ws, unnest(generate_series(0, len(ws) - least(len(ws), 10))) AS i FROM b WHERE len(ws) > 0)),
        sizes AS (SELECT DISTINCT len(win) AS n FROM bw),
        d AS (SELECT doc_id, coalesce({WORDS.format("text")}, []) AS ws FROM documents),
        dw AS (SELECT doc_id, n, i, list_slice(ws, i + 1, i + n) AS win
               FROM (SELECT doc_id, n, ws, unnest(generate_series(0, len(ws) - n)) AS i FROM d, sizes WHERE len(ws) >= n)),
        hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win),
        word AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
                 FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_chat_formatting": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, role || chr(10) || text AS ord, CASE WHEN role = 'assistant' THEN text ELSE '' END AS said,
                     length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<:]', '', 'g')) + 15 AS n FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(ord || chr(10), '' ORDER BY turn, ord)) AS turns_sha256,
               CAST(sum(length(said)) AS BIGINT) AS loss_chars, sha256(string_agg(said, '' ORDER BY turn, ord)) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op6_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {PIECES} AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
        FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)""",
    "op11_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
        r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op12_prefix_trie": f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role, text) AS ts FROM t GROUP BY conv_id),
        h AS (SELECT *, CAST({crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS BIGINT) AS h FROM o),
        b AS (SELECT h.conv_id, list_concat(list_slice(coalesce(g.ts, []), 1, h), list_slice(h.ts, h + 1, len(h.ts))) AS ts FROM h LEFT JOIN o g ON g.conv_id = h.conv_id - h.conv_id % 5),
        k AS (SELECT conv_id, len(ts) AS n, ts, list_transform(range(0, len(ts) + 1), lambda d: sha256(to_json(list_slice(ts, 1, d)))) AS ks FROM b),
        p AS (SELECT conv_id, n, unnest(range(0, n + 1)) AS depth, ks, ts FROM k),
        q AS (SELECT conv_id, depth, ks[depth + 1] AS key, CASE WHEN depth > 0 THEN ks[depth] END AS parent, CASE WHEN depth > 0 THEN octet_length(encode(ts[depth].t)) ELSE 0 END AS nb, n = depth AS ends FROM p),
        node AS (SELECT key, depth, parent, nb, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS own FROM q GROUP BY ALL),
        kids AS (SELECT parent AS key, count(*) AS n_children FROM node WHERE parent IS NOT NULL GROUP BY parent),
        below AS (SELECT DISTINCT x.key AS top, y.key AS key FROM (SELECT conv_id, depth, key FROM q) x JOIN (SELECT conv_id, depth, key FROM q) y ON x.conv_id = y.conv_id AND x.depth <= y.depth),
        sums AS (SELECT top AS key, count(*) FILTER (kids.key IS NULL) AS n_leaves, sum((n_convs - 1) * nb) AS saved FROM below JOIN node ON node.key = below.key LEFT JOIN kids ON kids.key = below.key GROUP BY top)
        SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(node.own) AS ends_sha256
        FROM node LEFT JOIN node up ON up.key = node.parent LEFT JOIN kids ON kids.key = node.key JOIN sums ON sums.key = node.key""",
    "op13_importance_resampling": f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({WORDS.format("text")}, []) AS ws FROM documents),
        dw AS (SELECT rid, unnest(ws) AS w FROM d), bw AS (SELECT unnest({WORDS.format("text")}) AS w FROM benchmark),
        code AS (SELECT w, {crc32_sql("w")} % 10000 AS k FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
        s AS (SELECT k, count(*) AS n FROM dw JOIN code USING (w) GROUP BY k), t AS (SELECT k, count(*) AS n FROM bw JOIN code USING (w) GROUP BY k),
        g AS (SELECT s.k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * CAST((SELECT count(*) FROM dw) + 10000 AS DOUBLE) / ((s.n + 1) * CAST((SELECT count(*) FROM bw) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t ON t.k = s.k),
        m AS (SELECT rid, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM dw JOIN code USING (w) JOIN g USING (k) GROUP BY rid),
        e AS (SELECT rid, doc_id, len(ws) AS n, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (rid)),
        f AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM e),
        r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS pool FROM f WHERE n >= 20)
        SELECT doc_id, n AS n_features, weight, score, CASE WHEN rank <= pool * 10 // 100 THEN rank END AS rank FROM f LEFT JOIN r USING (rid)""",
}
