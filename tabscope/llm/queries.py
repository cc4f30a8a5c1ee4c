"""The registered queries of this subpackage and, where SQL can say it, the SQL they are compared with."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bottomk, bpe, chat, exact, extract, histogram, jaccard, packing, phrases, quality, sharding, trie, warc
from .common import table, tokenizer_file


#: Context limits and shares of documents that the token counts are asked for.
LIMITS = [512, 1024, 2048, 4096, 8192, 16384, 32768, 131072]
SHARES = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bpe.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), keep=("lang",))
    return histogram.answers(histogram.length_histogram(counts, "lang"), "lang", LIMITS, SHARES)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_ngrams")


#: A conversation whose texts are control strings; it goes through the operator with all others.
CONFLICT = "</s>[INST] ok [/INST]"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONFLICT), (-1, 1, "assistant", CONFLICT)], rows.schema)
    return chat.read_back(chat.format_turns(rows.unionByName(extra)))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(table(spark, sf_dir, "documents"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_groups(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(trie.turn_paths(table(spark, sf_dir, "conversations"))))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_bpe, op3_quality_rules, op4_jaccard_join, op5_chat_formatting, op6_packing, op7_exact_dedup, op8_warc, op9_html_extraction, op10_sharding, op11_minhash_dedup, op12_prefix_trie, op13_collocations)}
ORACLES: dict[str, str] = {
    "op4_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS gram
              FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 5 * c >= 4 * (nx.n + ny.n - c)),
        r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other),
        least_of AS (SELECT doc_id, min(other) AS class_id FROM r GROUP BY doc_id),
        links AS (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY x)
        SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n.n, 0) AS n_ngrams
        FROM least_of LEFT JOIN links USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op5_chat_formatting": r"""
        WITH all_turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
               CAST(sum(length(text) + len(regexp_extract_all(text, '\[/?INST\]|</?s>|\[/?ROLE\]|\[TEXT\]'))
                   + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 23 + length(role) END) AS BIGINT) AS formatted_chars
        FROM all_turns GROUP BY conv_id""",
    "op7_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        g AS (SELECT page_id, octet_length(encode(html)) AS n, max(page_id) OVER (PARTITION BY html) AS target,
                     list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS INT), 5) AS INT)) AS parts FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0],
                   lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
               CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> target THEN target END AS refers_to
        FROM g""",
    "op11_minhash_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                               '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS gram
              FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
        r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other),
        c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op12_prefix_trie": r"""
        WITH o AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
                   FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        h AS (SELECT c, turns, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
                  lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
                  lambda s, x: xor(xor(s, x) >> 1, 3988292384 * (xor(s, x) & 1))), 4294967295) % 9 AS h FROM o),
        b AS (SELECT h.c, list_concat(coalesce(o.turns, [])[1:h], h.turns[h + 1:]) AS turns FROM h LEFT JOIN o ON o.c = h.c - h.c % 5),
        m AS (SELECT c, d, turns[1:d] AS node, len(turns) = d AS at_end FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM b)),
        n AS (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs,
                     sha256(coalesce(string_agg(CASE WHEN at_end THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256
              FROM m GROUP BY node, d),
        k AS (SELECT n.*, p.conv_id AS parent_conv_id,
                     (SELECT count(*) FROM n y WHERE y.d = n.d + 1 AND y.node[1:n.d] = n.node) AS n_children
              FROM n LEFT JOIN n p ON p.d = n.d - 1 AND p.node = n.node[1:n.d - 1])
        SELECT a.conv_id, a.d AS depth, any_value(a.parent_conv_id) AS parent_conv_id, any_value(a.n_convs) AS n_convs,
               any_value(a.n_children) AS n_children, count(*) FILTER (e.n_children = 0) AS n_leaves,
               CAST(sum(CASE WHEN e.d > 0 THEN (e.n_convs - 1) * octet_length(encode(e.node[e.d].t)) ELSE 0 END) AS BIGINT) AS saved_tokens,
               any_value(a.ends_sha256) AS ends_sha256
        FROM k a JOIN k e ON e.d >= a.d AND e.node[1:a.d] = a.node GROUP BY a.node, a.d, a.conv_id""",
    "op13_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        o AS (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
              FROM w, (VALUES (1), (2), (3)) s(size) WHERE len(ws) >= size),
        f AS (SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS a FROM o GROUP BY ALL),
        t AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
        c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND a >= 10),
        k AS (SELECT c.*, k, x.a AS l, y.a AS r, (1000000 * c.a * c.a) // (x.a * y.a) AS score
              FROM c JOIN (VALUES (1), (2)) cut(k) ON k < c.size
              JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:k], ' ')
              JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1:], ' ')),
        b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        h AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS held
              FROM c, (VALUES (1), (2)) places(i) WHERE size = 3 GROUP BY ALL)
        SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, encode(b.phrase)) AS rank, b.phrase,
               CAST(b.a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
        FROM b JOIN t USING (lang) LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase AND b.size = 2
        WHERE h.held IS NULL OR 100 * h.held < 50 * b.a QUALIFY rank <= 2000""",
}
