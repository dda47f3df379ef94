"""The registered queries of this subpackage: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.llm._tables import id_crc, table
from tonegrid.llm.anchors import drop_repeated_windows
from tonegrid.llm.decontaminate import decontaminate
from tonegrid.llm.embeddings import near_vectors
from tonegrid.llm.language import fit_language, identify
from tonegrid.llm.licenses import PHRASES, THRESHOLD, scan_licenses, template_tokens
from tonegrid.llm.manifest import build_manifest, digest, fold_proof, leaf_digest
from tonegrid.llm.pieces import encode_pieces
from tonegrid.llm.quality import fit_quality, score_quality
from tonegrid.llm.rules import RULES, STOP_WORDS, apply_rules
from tonegrid.llm.simhash import near_duplicates
from tonegrid.llm.suffixes import mark_repeats
from tonegrid.llm.token_files import round_trip
from tonegrid.llm.tries import build_trie, rebuild


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"), keep=["doc_id"], ids=False, decoded=False)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc("doc_id") % 3 == 1
    model = fit_language(docs, ~held_out)
    return identify(docs.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"), end_id=2)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc("doc_id") % 4 == 2
    model = fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score_quality(docs.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"], keep_first=False, digest=True)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_windows(table(spark, sf_dir, "documents"), keep=["doc_id"], digest=True)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_trie(rebuild(table(spark, sf_dir, "conversations")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fields = table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"]
    added = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    tampered = leaf_digest([added if c == "n_chars" else F.col(c) for c in fields])
    docs = docs.withColumn("claimed", F.when(id_crc("doc_id") % 7 == 0, tampered))
    leaves = build_manifest(docs, fields, "lang", "doc_id", keep=["doc_id", "claimed"])
    proof = digest(F.array_join(F.transform("proof", lambda s: s["hash"]), ""))
    leaves = leaves.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold_proof(F.coalesce("claimed", "leaf"), F.col("proof")).alias("folded_root"))
    return leaves.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.withColumn("failed_rules", F.array_join("failed_rules", ","))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language_id": op2_language_id,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_simhash": op4_simhash,
    "op5_license_scan": op5_license_scan,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_files": op7_token_files,
    "op8_quality": op8_quality,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_quality_rules": op13_quality_rules,
}

_A_TO_Z = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _A_TO_Z + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _license_sql() -> str:
    quoted = lambda tokens: "[" + ", ".join(f"'{t}'" for t in tokens) + "]"
    templates = ", ".join(f"({n}, '{label}', {quoted(tokens)}, {length}, {quoted(marks)})" for n, (label, tokens, length, marks) in enumerate(template_tokens()))
    phrases = ", ".join(f"('{label}', {quoted(p.split())})" for p, label in PHRASES)
    return f"""WITH t(n, label, tokens, length, marks) AS (VALUES {templates}), p(label, words) AS (VALUES {phrases}),
      d AS (SELECT doc_id, {_WORDS.format("text")} AS words FROM documents),
      b AS (SELECT d.doc_id, p.label, i - 1 AS start FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d) d, p WHERE d.words[i] = p.words[1] AND d.words[i : i + len(p.words) - 1] = p.words),
      bs AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY 1),
      v AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM d),
      m AS (SELECT doc_id, label, count(DISTINCT word) / len(tokens) AS share, count(DISTINCT word) FILTER (list_contains(marks, word)) = len(marks) AS sure FROM v JOIN t ON list_contains(tokens, word), (VALUES (0), (1)) o(o) WHERE place // length >= o
        GROUP BY doc_id, n, label, tokens, marks, place // length - o HAVING count(DISTINCT word) / len(tokens) >= {THRESHOLD}),
      lab AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM m UNION SELECT doc_id, label FROM b) GROUP BY 1),
      q AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS doubtful FROM (SELECT DISTINCT doc_id, label FROM m EXCEPT SELECT doc_id, label FROM m WHERE sure EXCEPT SELECT doc_id, label FROM b) GROUP BY 1),
      s AS (SELECT doc_id, max(share) AS share FROM m GROUP BY 1)
      SELECT d.doc_id, len(d.words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(doubtful, '') AS doubtful_labels,
      CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score FROM d LEFT JOIN bs ON bs.doc_id = d.doc_id LEFT JOIN lab ON lab.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id"""


def _crc_sql(text: str) -> str:
    """crc32 bit by bit, of ASCII text."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, k: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {byte}), 4294967295)"


def _trie_sql() -> str:
    return f"""WITH t AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
      c AS (SELECT t.conv_id AS c, t.own, b.own AS base, ({_crc_sql("CAST(t.conv_id AS VARCHAR)")} % 6)::INTEGER AS h FROM t LEFT JOIN t b ON b.conv_id = t.conv_id - t.conv_id % 100),
      s AS (SELECT c, coalesce(base[1 : h], []) || own[h + 1 :] AS seq FROM c),
      m AS (SELECT c, d, seq[1 : d] AS pre, seq[1 : d - 1] AS up, seq[d].x AS last, d = len(seq) AS ends FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM s)),
      n AS (SELECT min(c) AS conv_id, d AS depth, pre, any_value(up) AS up, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(any_value(last)) END AS saved,
        sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY d, pre),
      k AS (SELECT n.conv_id, n.depth, p.conv_id AS parent, n.pre, n.n_convs, n.saved, n.ends_sha256, (SELECT count(*) FROM n o WHERE o.depth = n.depth + 1 AND o.up = n.pre) AS n_children
        FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.pre = n.up),
      a AS (SELECT m.pre, m.d, sum(k.saved) AS saved, count(*) FILTER (k.n_children = 0) AS leaves FROM k JOIN m ON m.c = k.conv_id AND m.d <= k.depth GROUP BY 1, 2)
      SELECT k.conv_id, k.depth, k.parent AS parent_conv_id, k.n_convs, k.n_children, a.leaves AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, k.ends_sha256 FROM k JOIN a ON a.d = k.depth AND a.pre = k.pre"""


def _manifest_sql() -> str:
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda n: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    tree = lambda name, of: f"{name}(g, lev, i, n, h) AS (SELECT g, 0, i, n, h FROM {of} UNION ALL SELECT g, lev + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY g, lev, i // 2, n)"
    climb = lambda name, of, t: f"""{name}(doc, k, g, lev, i, n, proof, acc) AS (SELECT doc, k, g, 0, i, n, proof, acc FROM {of} UNION ALL
      SELECT p.doc, p.k, p.g, p.lev + 1, p.i // 2, (p.n + 1) // 2, proof || coalesce(s.h, ''), sha256(CASE WHEN s.i < p.i THEN s.h || acc WHEN s.i > p.i THEN acc || s.h ELSE acc END)
      FROM {name} p LEFT JOIN {t} s ON s.g IS NOT DISTINCT FROM p.g AND s.lev = p.lev AND s.i = xor(p.i, 1) WHERE p.n > 1)"""  # noqa: E731
    return f"""WITH RECURSIVE l AS (SELECT doc_id AS doc, lang AS g, {leaf("n_chars")} AS h, CASE WHEN {_crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {leaf("(n_chars + 1)")} END AS claimed FROM documents),
      r AS (SELECT doc, g, h, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (ORDER BY g, doc, h) AS k, '' AS proof, coalesce(claimed, h) AS acc FROM l WINDOW w AS (PARTITION BY g ORDER BY doc NULLS FIRST, h)),
      {tree("t", "r")}, sub AS (SELECT g AS lang, 0 AS g, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1), {tree("u", "sub")},
      {climb("p", "r", "t")}, q AS (SELECT doc, k, sub.g, sub.i, sub.n, proof, acc FROM p JOIN sub ON sub.lang IS NOT DISTINCT FROM p.g WHERE p.n = 1), {climb("v", "q", "u")}
      SELECT r.doc AS doc_id, r.h AS leaf, sub.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(v.proof) AS proof_sha256, v.acc AS folded_root, v.acc = (SELECT h FROM u WHERE n = 1) AS verified
      FROM v JOIN r ON r.k = v.k JOIN sub ON sub.lang IS NOT DISTINCT FROM r.g WHERE v.n = 1"""


def _rules_sql() -> str:
    words = "list_filter(regexp_split_to_array(text, '[ \\x09-\\x0D]+'), lambda x: x <> '')"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    broken = lambda r: " OR ".join([f"100 * {r.count} < {r.least} * {r.of}"] * (r.least is not None) + [f"100 * {r.count} > {r.most} * {r.of}"] * (r.most is not None))
    failed = ", ".join(f"CASE WHEN n_words >= {r.from_words} AND ({broken(r)}) THEN '{r.name}' END" for r in RULES)
    matching = lambda rx: f"len(list_filter(lines, lambda x: regexp_matches(x, '{rx}')))"
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
      w AS (SELECT doc_id, text, {words} AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS lines FROM d),
      x AS (SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
      r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM x) WHERE n > 1),
      c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, range(5) t(j) GROUP BY 1),
      m AS (SELECT w.doc_id, len(words) AS n_words, CAST(list_sum(list_transform(words, lambda x: length(x))) AS BIGINT) AS chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
        len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words, CASE WHEN strlen(text) * 2 < length(text) * 3 THEN len(words) ELSE 0 END AS n_latin_words,
        len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop_words, {matching("^[ \\t]*[-*•]")} AS n_bullet_lines, {matching("(\\.\\.\\.|…)[ \\t\\r]*$")} AS n_ellipsis_lines
        FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
      f AS (SELECT *, coalesce(chars, 0) AS word_chars, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
      g AS (SELECT *, concat_ws(',', {failed}) AS failed_rules FROM f)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM g"""


#: DuckDB statements of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op3_embedding_dedup": """WITH RECURSIVE l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND a.label = b.label AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.98),
      r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1), c AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
      SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id, vec_id <= coalesce(c.b, vec_id) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""",
    "op5_license_scan": _license_sql(),
    "op6_decontaminate": f"""WITH bw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark), p AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
      d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), x AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
      h AS (SELECT doc_id, item, i, x.n FROM x JOIN p ON p.s = x.s AND p.n = x.n), k AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, range(13) r(j) WHERE j < n GROUP BY 1),
      it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
      SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id""",
    "op9_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
      e AS (SELECT doc_id, base, substring(h, 2 * base + 1, 2798) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399, 1000)) AS base FROM d)),
      w AS (SELECT doc_id, base + j AS i, md5_number(substring(g, 2 * j + 1, 800)) AS m FROM (SELECT doc_id, base, g, unnest(range(0, least(1000, length(g) // 2 - 399))) AS j FROM e)),
      r AS (SELECT doc_id, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
      g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (SELECT *, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 400)::INTEGER AS fresh FROM r)),
      s AS (SELECT doc_id, span, min(i) AS lo, max(i) + 400 AS hi FROM g GROUP BY 1, 2), n AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last FROM s GROUP BY 1),
      k AS (SELECT s.doc_id, string_agg(substring(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept FROM (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM s) s JOIN d ON d.doc_id = s.doc_id GROUP BY 1)
      SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE kept || substring(h, 2 * last + 1) END)) AS kept_sha256
      FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op11_prefix_trie": _trie_sql(),
    "op12_merkle_manifest": _manifest_sql(),
    "op13_quality_rules": _rules_sql(),
    "op10_substring_dedup": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
      x AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)), m AS (SELECT s, min(doc_id) AS least FROM x GROUP BY 1),
      g AS (SELECT DISTINCT x.doc_id, i + j AS pos FROM x JOIN m ON m.s = x.s, range(13) r(j) WHERE least < x.doc_id), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
      u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w), k AS (SELECT u.doc_id, sha256(string_agg(word, ' ' ORDER BY u.pos)) AS sha FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.pos = u.pos WHERE g.pos IS NULL GROUP BY 1)
      SELECT w.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, coalesce(sha, sha256('')) AS kept_sha256 FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id""",
}
