"""The catalogue's questions in DuckDB's SQL."""

from __future__ import annotations

from ..functions.text import BREAKS, CLAUSE_LINE, SPACES
from ..operators.tables import METADATA, SEED


def _q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


_B, _S = BREAKS, SPACES
_DIRTY = "list_aggregate(list_transform({v}, lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 1 ELSE 0 END), 'sum')"


def _normalized(text: str) -> str:
    step = f"regexp_replace(nfc_normalize({text}), {_q(chr(13) + chr(10) + '|[' + _B + ']')}, {_q(chr(10))}, 'g')"
    step = f"regexp_replace({step}, {_q('[' + _S + ']+')}, ' ', 'g')"
    for _ in range(2):
        step = f"regexp_replace({step}, {_q(' ?' + chr(10) + ' ?')}, {_q(chr(10))}, 'g')"
    step = f"regexp_replace({step}, {_q(chr(10) + '{2,}')}, {_q(chr(10) * 2)}, 'g')"
    return f"regexp_replace({step}, {_q('^[ ' + chr(10) + ']+|[ ' + chr(10) + ']+$')}, '', 'g')"


_FILE = "list_extract(string_split(path, '/'), -1)"
_WORDS = f"regexp_extract_all(text, {_q('[^' + _B + _S + ']+')})"
_FLAT = f"regexp_replace(regexp_replace(text, {_q('[' + _B + _S + ']+')}, ' ', 'g'), '^ | $', '', 'g')"


def _snippet(flat: str) -> str:
    cut = f"regexp_extract({flat}, '^(.{{1,100}}) ', 1)"
    return f"CASE WHEN length({flat}) <= 100 THEN {flat} ELSE (CASE WHEN {cut} <> '' THEN {cut} ELSE substring({flat}, 1, 100) END) || '…' END"


_TERMS = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'), lambda t: strlen(t) <= 40)"


def _bm25(table: str, key: str) -> str:
    """CTEs that end in words(query_id, id, score)."""
    return f"""
once AS (SELECT id, {_TERMS} AS terms FROM (SELECT {key} AS id, max(text) AS text FROM {table} WHERE {key} IS NOT NULL GROUP BY 1)),
corpus AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM once),
postings AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(terms) AS length, unnest(terms) AS term FROM once) GROUP BY ALL),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT id AS query_id, unnest({_TERMS}) AS term FROM queries) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
words AS (
  SELECT query_id, id, round(sum(times * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (1 - 0.75e0 + 0.75e0 * length / mean))), 9) AS score
  FROM asked JOIN df USING (term) JOIN postings USING (term) CROSS JOIN corpus GROUP BY 1, 2)"""


def _ranked(source: str, name: str) -> str:
    return f"{name} AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {source})"


_USABLE = f"len(vec) = 64 AND {_DIRTY.format(v='vec')} = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0"
_SEMANTIC = f"""
near AS (
  SELECT q.id AS query_id, v.id, round(list_cosine_similarity(CAST(q.vec AS DOUBLE[]), CAST(v.vec AS DOUBLE[])), 9) AS score
  FROM queries q CROSS JOIN (SELECT chunk_id AS id, any_value(vec) AS vec FROM vectors WHERE {_USABLE} GROUP BY 1) v)"""


def _fused(kappa: float, name: str, a: str = "rw", b: str = "rn") -> str:
    return f"{name} AS (SELECT query_id, id, round(sum(1e0 / ({kappa}e0 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM {a} UNION ALL SELECT query_id, id, rank FROM {b}) GROUP BY 1, 2)"


_BOTH = f"{_bm25('chunks', 'id')}, {_SEMANTIC}, {_ranked('words', 'rw')}, {_ranked('near', 'rn')}"
_TOP = "SELECT query_id, id, round(score, 6) AS score, rank FROM {} WHERE rank <= 10"
_SPANS = "SELECT DISTINCT span_id, category, trim(file) AS file, char_start, char_end FROM spans WHERE category IS NOT NULL AND file IS NOT NULL AND char_start >= 0 AND char_start < char_end"
_PLACED = f"""
valid AS ({_SPANS}),
names AS (SELECT {_FILE} AS file, max(doc_id) AS doc_id FROM documents GROUP BY 1),
placed AS (SELECT category, doc_id, char_start AS s, char_end AS e FROM valid JOIN names USING (file)),
flagged AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY category, doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM placed),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY category, doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
islands AS (SELECT category, doc_id, min(s) AS s, max(e) AS e FROM numbered GROUP BY category, doc_id, island)"""
_QRELS = f"""{_PLACED},
pieces AS (SELECT id, min(doc_id) AS doc_id, min(char_start) AS char_start, min(char_end) AS char_end FROM chunks WHERE id IS NOT NULL AND doc_id IS NOT NULL AND char_start < char_end GROUP BY 1),
relevant AS (
  SELECT category, id FROM pieces JOIN placed USING (doc_id) WHERE char_start <= s AND e <= char_end
  UNION SELECT category, id FROM pieces JOIN islands USING (doc_id) WHERE s < char_end AND e > char_start
  GROUP BY category, id, char_start, char_end HAVING 2 * sum(greatest(0, least(char_end, e) - greatest(char_start, s))) >= char_end - char_start),
qrels AS (SELECT q.id AS query_id, r.id AS chunk_id FROM (SELECT DISTINCT id, category FROM queries) q JOIN relevant r USING (category))"""


def _metrics(runs: str, order: str) -> str:
    """CTE scores(method, query_id, ndcg, mrr, r_precision) from run(method, query_id, id, rank)."""
    return f"""
run AS ({runs}),
total AS (SELECT query_id, count(DISTINCT chunk_id) AS r FROM qrels GROUP BY 1),
found AS (
  SELECT method, run.query_id, sum(CASE WHEN rank <= 10 THEN 1e0 / log2(rank + 1) END) AS gain, min(CASE WHEN rank <= 10 THEN rank END) AS first, sum(CASE WHEN rank <= r THEN 1 ELSE 0 END) AS early
  FROM run JOIN qrels ON run.query_id = qrels.query_id AND run.id = qrels.chunk_id JOIN total ON total.query_id = run.query_id GROUP BY 1, 2),
ideal AS (SELECT query_id, sum(1e0 / log2(k + 1)) AS best FROM (SELECT query_id, unnest(range(1, least(10, r) + 1)) AS k FROM total) GROUP BY 1),
scores AS (
  SELECT m.method, q.id AS query_id, round(coalesce(gain / best, 0e0), 6) AS ndcg, round(coalesce(1e0 / first, 0e0), 6) AS mrr, round(coalesce(early::DOUBLE / r, 0e0), 6) AS r_precision
  FROM (SELECT DISTINCT method FROM run) m CROSS JOIN (SELECT DISTINCT id FROM queries) q LEFT JOIN total ON total.query_id = q.id LEFT JOIN ideal ON ideal.query_id = q.id LEFT JOIN found ON found.method = m.method AND found.query_id = q.id)"""


_METHODS = "SELECT 'bm25' AS method, query_id, id, rank FROM rw WHERE rank <= 1000 UNION ALL SELECT 'semantic', query_id, id, rank FROM rn WHERE rank <= 1000 UNION ALL SELECT 'hybrid', query_id, id, rank FROM rb WHERE rank <= 1000"
_SCORES = f"WITH {_BOTH}, {_fused(5, 'fusion')}, {_ranked('fusion', 'rb')}, {_QRELS}, {_metrics(_METHODS, '')}"


def _kappa() -> str:
    parts, runs = [], []
    for k in (1, 5, 20, 60):
        parts += [_fused(k, f"f{k}"), _ranked(f"f{k}", f"r{k}")]
        runs.append(f"SELECT 'kappa {k}' AS method, query_id, id, rank FROM r{k} WHERE rank <= 10")
    order = "CASE setting WHEN 'kappa 1' THEN 0 WHEN 'kappa 5' THEN 1 WHEN 'kappa 20' THEN 2 ELSE 3 END"
    return f"""WITH {_BOTH}, {', '.join(parts)}, {_QRELS}, {_metrics(' UNION ALL '.join(runs), '')},
per AS (SELECT method AS setting, substring(query_id, 1, 3) AS fold, sum(ndcg) AS own, avg(ndcg) AS mean FROM scores GROUP BY 1, 2),
rest AS (SELECT *, round(sum(own) OVER (PARTITION BY setting) - own, 6) AS others FROM per),
best AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY others DESC, {order}) AS place FROM rest),
chosen AS (SELECT fold, setting, round(mean, 6) AS held_out FROM best WHERE place = 1)"""


_UNIT = """
lengths AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS length FROM embeddings),
parts AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS place, unnest(embedding)::DOUBLE / length AS value FROM lengths)"""


def _nearest(where: str, k: int) -> str:
    return f"""WITH scored AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score FROM embeddings q CROSS JOIN embeddings e WHERE q.{where}),
{_ranked('scored', 'r')} SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= {k}"""


_LINES = f"lines AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split({_normalized('text')}, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
_NO_MARK = "regexp_replace(text, '^\ufeff', '')"
_IS_FORMAT = r"CASE WHEN regexp_matches({f}, '^\.*[^.].*\.(?i:pdf|docx|txt)$') THEN lower(regexp_extract({f}, '\.([^.]+)$', 1)) END"


def _packed(text: str = "text") -> str:
    """CTEs that end in packed(doc_id, ord, text, char_start, char_end): units folded into chunks of 200 words, longer ones cut into windows."""
    return f"""WITH RECURSIVE forms AS (SELECT doc_id, {_normalized(text)} AS form FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(form, chr(10)) AS l FROM forms)),
offsets AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(line) - 1 AS line_start FROM lines),
flagged AS (SELECT *, CASE WHEN line = '' OR regexp_matches(line, {_q(CLAUSE_LINE)}) THEN 1 ELSE 0 END AS new FROM offsets),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM flagged),
unit AS (SELECT doc_id, min(line_start)::BIGINT AS s, string_agg(line, chr(10) ORDER BY pos) AS text FROM grouped WHERE line <> '' GROUP BY doc_id, part),
counted AS (SELECT doc_id, s, s + length(text) AS e, {_WORDS} AS w, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k FROM unit),
fold AS (
  SELECT doc_id, k, s, e, w, CASE WHEN len(w) > 200 THEN 0 ELSE len(w) END AS held, 1 AS part FROM counted WHERE k = 1
  UNION ALL
  SELECT c.doc_id, c.k, c.s, c.e, c.w, CASE WHEN len(c.w) > 200 THEN 0 WHEN f.held > 0 AND f.held + len(c.w) <= 200 THEN f.held + len(c.w) ELSE len(c.w) END,
    f.part + CASE WHEN len(c.w) <= 200 AND f.held > 0 AND f.held + len(c.w) <= 200 THEN 0 ELSE 1 END
  FROM fold f JOIN counted c ON c.doc_id = f.doc_id AND c.k = f.k + 1),
long AS (SELECT doc_id, s, w, unnest(range(0, 1 + ceil((len(w) - 200) / 160e0)::BIGINT)) * 160 AS a FROM fold WHERE len(w) > 200),
pieces AS (
  SELECT doc_id, min(s) AS s, max(e) AS e FROM fold WHERE len(w) BETWEEN 1 AND 200 GROUP BY doc_id, part
  UNION ALL
  SELECT doc_id, s + coalesce(list_sum(list_transform(list_slice(w, 1, a), lambda x: length(x))), 0) + a,
    s + list_sum(list_transform(list_slice(w, 1, least(a + 200, len(w))), lambda x: length(x))) + least(a + 200, len(w)) - 1 FROM long),
packed AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p.s) - 1)::INT AS ord, substring(form, p.s::BIGINT + 1, (p.e - p.s)::BIGINT) AS text, p.s::INT AS char_start, p.e::INT AS char_end FROM pieces p JOIN forms USING (doc_id))"""


_PAIR_SCORES = """WITH p AS (SELECT a.vec_id // 2 AS pair, (a.vec_id // 2) // 32 AS batch, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
s AS (SELECT p.batch, p.pair, q.pair AS other, list_inner_product(p.x, q.y) AS score FROM p JOIN p q USING (batch)),
t AS (SELECT unnest([0.02e0, 0.05e0, 0.1e0, 0.2e0]) AS temperature),
r AS (SELECT temperature, pair, max(CASE WHEN other = pair THEN score END) AS own, max(score) AS best, ln(sum(exp(score / temperature))) AS whole FROM s CROSS JOIN t GROUP BY 1, 2),
loss AS (SELECT temperature, count(*) AS pairs, round(avg(whole - own / temperature), 6) AS loss, round(avg(CASE WHEN own = best THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM r GROUP BY 1)"""


def sql() -> dict[str, str]:
    file_format = _IS_FORMAT.format(f=_FILE)
    evaluation = "SELECT DISTINCT file FROM (SELECT trim(file) AS file FROM docs UNION ALL SELECT trim(file) FROM spans) WHERE file <> ''"
    pair = "SELECT 'semantic' AS method_a, 'bm25' AS method_b UNION ALL SELECT 'hybrid', 'bm25' UNION ALL SELECT 'hybrid', 'semantic'"
    trigram = "list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]))"
    own = {
        "packed_chunks": f"{_packed()} SELECT doc_id, ord, text, char_start, char_end FROM packed",
        "index_chunks": f"{_packed(_NO_MARK)} SELECT doc_id, ord, md5(text) AS md5, md5(text) AS source_md5 FROM packed",
        "index_numbers": f"{_packed(_NO_MARK)} SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, count(*) - 1 AS last_id, (SELECT count(*) FROM documents WHERE text IS NOT NULL) - count(DISTINCT doc_id) AS skipped, true AS reusable FROM packed",
        "query_file": "SELECT DISTINCT id, category, kind, text FROM queries",
        "span_file": f"SELECT category, file, char_start, char_end FROM ({_SPANS})",
        "name_file": "SELECT DISTINCT trim(file) AS file FROM docs WHERE trim(file) <> ''",
        "run_file": "SELECT DISTINCT query_id, chunk_id AS id, hit_rank AS rank, round(score::DOUBLE, 6) AS score, 'earlier' AS method FROM hits WHERE score IS NOT NULL AND NOT isnan(score)",
        "qrel_file": f"WITH {_QRELS} SELECT query_id, chunk_id FROM qrels",
        "vector_file": "SELECT id, generate_subscripts(embedding, 1) - 1 AS place, round(unnest(embedding)::DOUBLE, 6) AS value FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, embedding FROM embeddings)",
        "validation_loss": f"{_PAIR_SCORES} SELECT * FROM loss",
        "best_temperature": f"{_PAIR_SCORES} SELECT temperature, loss FROM loss ORDER BY loss, temperature LIMIT 1",
        "warm_up": "SELECT step, round(CASE WHEN step < 100 THEN 2e-5 * (step + 1) / 100 ELSE 2e-5 END, 12) AS rate FROM (SELECT unnest(range(300)) AS step)",
    }
    out = own | {
        "nearest_to_one": _nearest("vec_id = 0", 10).replace("SELECT query_id, id, round(score, 6)", "SELECT id, round(score, 6)"),
        "nearest_of_each": _nearest("vec_id % 50 = 0", 5),
        "label_recall": f"""WITH scored AS (SELECT q.vec_id AS query_id, q.label AS own, e.vec_id AS id, e.label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM scored)
SELECT own, count(DISTINCT query_id) AS queries, round(avg(CASE WHEN label = own THEN 1e0 ELSE 0e0 END), 6) AS recall, sum(CASE WHEN place = 1 THEN CASE WHEN label = own THEN 1e0 ELSE 0e0 END END) AS top_1 FROM placed WHERE place <= 10 GROUP BY own""",
        "unit_vectors": f"WITH {_UNIT} SELECT vec_id, place, round(value, 6) AS value FROM parts",
        "label_centroids": f"WITH {_UNIT} SELECT label, place, round(avg(value), 6) AS mean, count(*) AS n FROM parts GROUP BY 1, 2",
        "label_margin": """WITH pairs AS (SELECT a.label, a.label = b.label AS own, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT label, round(avg(CASE WHEN own THEN c END) - avg(CASE WHEN NOT own THEN c END), 6) AS margin FROM pairs GROUP BY 1 HAVING count(CASE WHEN own THEN 1 END) > 0 AND count(CASE WHEN NOT own THEN 1 END) > 0""",
        "vector_faults": f"""SELECT CASE WHEN vec IS NULL THEN 'null' WHEN len(vec) <> 64 THEN 'length' WHEN {_DIRTY.format(v='vec')} > 0 THEN 'not finite' WHEN len(list_filter(vec, lambda x: x <> 0)) = 0 THEN 'zero' ELSE 'usable' END AS fault, count(*) AS n
FROM (SELECT chunk_id, any_value(vec) AS vec FROM vectors GROUP BY 1) GROUP BY 1""".replace("any_value(vec)", "first(vec)"),
        "hash_embeddings": f"""WITH counts AS (SELECT doc_id, (CAST('0x' || substring(md5(term), 1, 6) AS BIGINT) % 64)::INT AS bucket, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY 1, 2)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM counts""",
        "normalized_text": f"SELECT doc_id, md5({_normalized('text')}) AS md5 FROM documents WHERE text IS NOT NULL",
        "joined_hyphens": rf"SELECT doc_id, md5(regexp_replace({_normalized('text')}, '(\p{{L}})-{chr(10)}(\p{{Ll}})', '\1\2', 'g')) AS md5 FROM documents WHERE text IS NOT NULL AND {file_format} = 'pdf'",
        "clause_lines": f"WITH {_LINES} SELECT doc_id, count(*) AS lines, count(CASE WHEN regexp_matches(line, {_q(CLAUSE_LINE)}) THEN 1 END) AS clauses FROM lines GROUP BY 1",
        "clause_units": f"""WITH {_LINES},
flagged AS (SELECT *, line = '' AS blank, CASE WHEN line = '' OR regexp_matches(line, {_q(CLAUSE_LINE)}) THEN 1 ELSE 0 END AS new FROM lines),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM flagged),
texts AS (SELECT doc_id, part, string_agg(line, chr(10) ORDER BY pos) AS text FROM grouped WHERE NOT blank GROUP BY 1, 2)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1)::INT AS unit, md5(text) AS md5 FROM texts""",
        "word_windows": f"""WITH limits AS (SELECT source, min(max_tokens) AS size, min(max_tokens) - arg_min(overlap, max_tokens) AS step FROM chunk_config GROUP BY 1),
texts AS (SELECT doc_id, {_WORDS} AS w, size, step FROM documents JOIN limits USING (source) WHERE text IS NOT NULL),
parts AS (SELECT doc_id, w, size, step, unnest(range(0, greatest(0, ceil((len(w) - size) / step::DOUBLE))::BIGINT + 1)) AS ord FROM texts WHERE len(w) > 0)
SELECT doc_id, ord::INT AS ord, len(list_slice(w, ord * step + 1, ord * step + size))::INT AS words, md5(array_to_string(list_slice(w, ord * step + 1, ord * step + size), ' ')) AS md5 FROM parts""",
        "snippets": f"SELECT doc_id, {_snippet('flat')} AS snippet FROM (SELECT doc_id, {_FLAT} AS flat FROM documents WHERE text IS NOT NULL)",
        "text_hashes": "SELECT doc_id, sha256(text) AS sha256, lower(hex(hash)) AS hash FROM documents",
        "document_formats": f"SELECT {file_format} AS format, doc_format, count(*) AS n FROM documents GROUP BY 1, 2",
        "shared_trigrams": f"""WITH valid AS ({_SPANS}), names AS (SELECT trim({_FILE}) AS file, arg_max(text, doc_id) AS whole FROM documents WHERE text IS NOT NULL GROUP BY 1),
held AS (SELECT span_id, regexp_extract_all(lower(substring(whole, char_start + 1, char_end - char_start)), '[a-z0-9]+') AS w FROM valid JOIN names USING (file)),
spoken AS (SELECT DISTINCT span_id, unnest({trigram}) AS trigram FROM held WHERE len(w) >= 3),
asked AS (SELECT DISTINCT id, unnest({trigram}) AS trigram FROM (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM queries) WHERE len(w) >= 3)
SELECT id, span_id, count(*) AS shared FROM asked JOIN spoken USING (trigram) GROUP BY 1, 2""",
        "bm25_documents": f"WITH {_bm25('documents', 'doc_id')}, {_ranked('words', 'r')} {_TOP.format('r')}",
        "bm25_chunks": f"WITH {_bm25('chunks', 'id')}, {_ranked('words', 'r')} {_TOP.format('r')}",
        "semantic_chunks": f"WITH {_SEMANTIC}, {_ranked('near', 'r')} {_TOP.format('r')}",
        "hybrid_kappa_5": f"WITH {_BOTH}, {_fused(5, 'fusion')}, {_ranked('fusion', 'rb')} {_TOP.format('rb')}",
        "hybrid_kappa_60": f"WITH {_BOTH}, {_fused(60, 'fusion')}, {_ranked('fusion', 'rb')} {_TOP.format('rb')}",
        "hit_details": f"""WITH once AS (SELECT DISTINCT query_id, hit_rank, chunk_id, score FROM hits), c AS (SELECT id AS chunk_id, max(doc_id) AS doc_id, max(page) AS page, max(text) AS text FROM chunks WHERE id IS NOT NULL GROUP BY 1),
f AS (SELECT DISTINCT doc_id, trim({_FILE}) AS file FROM documents)
SELECT query_id, hit_rank, chunk_id, CASE WHEN NOT isnan(score) THEN round(score::DOUBLE, 6) END AS score, file, page, {_snippet('flat')} AS snippet FROM (SELECT *, {_FLAT} AS flat FROM once LEFT JOIN c USING (chunk_id) LEFT JOIN f USING (doc_id))""",
        "span_islands": f"WITH {_PLACED} SELECT category, doc_id, s, e FROM islands",
        "relevant_chunks": f"WITH {_QRELS} SELECT query_id, chunk_id FROM qrels",
        "relevance_counts": f"WITH {_QRELS} SELECT q.id AS query_id, count(chunk_id) AS relevant FROM queries q LEFT JOIN qrels ON qrels.query_id = q.id GROUP BY 1",
        "metrics_per_query": f"{_SCORES} SELECT * FROM scores",
        "metrics_by_kind": f"""{_SCORES} SELECT method, CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind, count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, round(avg(r_precision), 6) AS r_precision
FROM scores JOIN (SELECT DISTINCT id AS query_id, kind FROM queries) USING (query_id) GROUP BY GROUPING SETS ((method, kind), (method))""",
        "signed_ranks": f"""{_SCORES}, wanted AS ({pair}),
d AS (SELECT w.method_a, w.method_b, a.query_id, round(a.ndcg - b.ndcg, 6) AS d FROM wanted w JOIN scores a ON a.method = w.method_a JOIN scores b ON b.method = w.method_b AND b.query_id = a.query_id),
ordered AS (SELECT *, row_number() OVER (PARTITION BY method_a, method_b ORDER BY abs(d), query_id) AS place FROM d WHERE d <> 0),
shared AS (SELECT *, avg(place) OVER (PARTITION BY method_a, method_b, abs(d)) AS rank, count(*) OVER (PARTITION BY method_a, method_b, abs(d)) AS t FROM ordered)
SELECT w.method_a, w.method_b, count(d) AS n, coalesce(sum(CASE WHEN d > 0 THEN rank ELSE 0 END), 0)::DOUBLE AS w_plus, coalesce(sum(CASE WHEN d < 0 THEN rank ELSE 0 END), 0)::DOUBLE AS w_minus, coalesce(sum(t * t - 1), 0)::DOUBLE AS ties
FROM wanted w LEFT JOIN shared s ON s.method_a = w.method_a AND s.method_b = w.method_b GROUP BY 1, 2""",
        "kappa_by_fold": f"{_kappa()} SELECT * FROM chosen",
        "kappa_votes": f"{_kappa()} SELECT setting, count(*) AS folds FROM chosen GROUP BY 1",
        "run_lines": f"WITH {_BOTH}, {_fused(5, 'fusion')}, {_ranked('fusion', 'rb')}, run AS ({_METHODS.replace('id, rank', 'id, score, rank')}) SELECT printf('%s Q0 %d %d %.9f %s', query_id, id, rank, round(score + 1e-10, 6), method) AS line FROM run",
        "qrel_lines": f"WITH {_QRELS} SELECT printf('%s 0 %d 1', query_id, chunk_id) AS line FROM qrels",
        "latency_by_type": "SELECT event_type, count(*) AS n, round(median(value), 6) AS median, round(quantile_disc(value, 0.95), 6) AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1",
        "kept_categories": f"""WITH valid AS ({_SPANS}), files AS (SELECT count(DISTINCT trim(file)) AS files FROM docs WHERE trim(file) <> '')
SELECT category, count(DISTINCT file) AS contracts FROM valid WHERE category NOT IN ({', '.join(map(_q, METADATA))}) GROUP BY 1 HAVING count(DISTINCT file) <= 0.9 * (SELECT files FROM files)""",
        "held_out_documents": f"SELECT doc_id, trim({_FILE}) AS file FROM documents WHERE coalesce(trim({_FILE}), '') NOT IN ({evaluation})",
        "missing_evaluation_files": f"SELECT file FROM ({evaluation}) WHERE file NOT IN (SELECT trim({_FILE}) FROM documents WHERE path IS NOT NULL)",
        "training_pairs": f"""WITH valid AS ({_SPANS}), pairs AS (SELECT span_id, q.id AS query_id, category FROM (SELECT span_id, category FROM valid) v JOIN (SELECT DISTINCT id, category FROM queries) q USING (category)),
placed AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(concat_ws('|', span_id, query_id, {_q(SEED)})), span_id, query_id) AS place FROM pairs) SELECT span_id, query_id, category FROM placed WHERE place <= 20""",
        "training_batches": f"""WITH valid AS ({_SPANS}), pairs AS (SELECT span_id, q.id AS query_id, category FROM (SELECT span_id, category FROM valid) v JOIN (SELECT DISTINCT id, category FROM queries) q USING (category)),
placed AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(concat_ws('|', span_id, query_id, {_q(SEED)})), span_id, query_id) AS place FROM pairs) SELECT span_id, query_id, category, place - 1 AS batch FROM placed WHERE place <= 20""",
        "contract_parts": f"WITH valid AS ({_SPANS}) SELECT span_id, file, CASE WHEN CAST('0x' || substring(md5(concat_ws('|', file, {_q(SEED)})), 1, 8) AS BIGINT) / 4294967296e0 < 0.2 THEN 'validation' ELSE 'train' END AS part FROM valid",
        "sampled_documents": f"SELECT doc_id, path FROM documents ORDER BY md5(concat_ws('|', path, {_q(SEED)})), path LIMIT 30",
        "page_offsets": """WITH once AS (SELECT id, min(doc_id) AS doc_id, min(ord) AS ord, min(length(text)) AS n FROM chunks WHERE id IS NOT NULL GROUP BY 1)
SELECT doc_id, ord, coalesce(sum(n + 2) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM once""",
        "passage_pages": f"""WITH starts AS (SELECT doc_id, page, min(char_start) AS off FROM chunks WHERE page IS NOT NULL AND char_start IS NOT NULL GROUP BY 1, 2), f AS (SELECT trim({_FILE}) AS file, max(doc_id) AS doc_id FROM documents GROUP BY 1),
once AS (SELECT passage_id, max(trim(file)) AS file, max(char_start) AS char_start FROM passages WHERE passage_id IS NOT NULL GROUP BY 1),
placed AS (SELECT passage_id, page, row_number() OVER (PARTITION BY passage_id ORDER BY off DESC, page DESC) AS place FROM once LEFT JOIN f USING (file) LEFT JOIN starts ON starts.doc_id = f.doc_id AND off <= char_start) SELECT passage_id, page FROM placed WHERE place = 1""",
        "dense_chunk_ids": """WITH c AS (SELECT id, min(doc_id) AS doc_id, min(ord) AS ord FROM chunks WHERE id IS NOT NULL GROUP BY 1), d AS (SELECT DISTINCT doc_id, path FROM documents)
SELECT id, row_number() OVER (ORDER BY path, ord, id) - 1 AS number FROM c JOIN d USING (doc_id)""",
        "table_counts": "SELECT 'documents' AS name, count(*) AS row_count, count(DISTINCT doc_id) AS keys FROM documents UNION ALL SELECT 'chunks', count(*), count(DISTINCT id) FROM chunks UNION ALL SELECT 'passages', count(*), count(DISTINCT passage_id) FROM passages",
    }
    margins, recalls = out["label_margin"], out["label_recall"]
    out["template_gate"] = f"""WITH m AS (SELECT count(*) AS n, avg(margin) AS mean, count(CASE WHEN margin > 0 THEN 1 END) AS positive FROM ({margins})),
f AS (SELECT sum(top_1) / sum(queries) AS rate FROM ({recalls})),
b AS (SELECT least(1e0, 2 * sum(factorial(n::INT)::DOUBLE / (factorial(i::INT)::DOUBLE * factorial((n - i)::INT)::DOUBLE)) / pow(2, n)) AS p FROM (SELECT n, unnest(range(0, least(positive, n - positive) + 1)) AS i FROM m) GROUP BY n)
SELECT n AS templates, round(mean, 6) AS mean_margin, positive, round(rate, 6) AS first_rate, round(p, 6) AS sign_p, mean > 0.01 AND positive >= 0.8 * n AND rate > 3e0 / (SELECT count(DISTINCT label) FROM embeddings) AS passed FROM m, f, b"""
    return out
