"""Registered queries of document preparation, tables, contexts and text metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.operators import chunking, context, embed, metrics, packing, search
from docquery.operators import tables as tb
from docquery.sources import fixtures as fx
from docquery.sources.tables import table

C, S, FI, T = fx.CHUNKS_SQL, fx.SCORED_SQL, fx.FILES_SQL, fx.TABLES_SQL


def marked(spark: SparkSession, sf: str) -> DataFrame:
    """Files with a blank line between lines, every seventh line a heading."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 7 == 0, F.concat(F.lit("# "), x)).otherwise(x))
    return fx.files(spark, sf).withColumn("text", F.array_join(lines, "\n\n"))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.with_sections(chunking.paragraphs(marked(spark, sf)).withColumn("page_number", F.expr("block_idx div 10 + 1").cast("int")))


BLOCKS_SQL = rf"""{FI}, parts AS (SELECT document_id, unnest(ps) AS text, unnest(range(len(ps))) AS block_idx FROM (
  SELECT document_id, list_filter(list_transform(string_split(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 7 = 0 THEN '# ' || x ELSE x END), chr(10) || chr(10)), chr(10) || chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM files)),
blocks AS (SELECT document_id, block_idx, CASE WHEN starts_with(text, '#') THEN 'heading' ELSE 'paragraph' END AS type, text, CAST(block_idx // 10 + 1 AS INTEGER) AS page_number,
  coalesce(last_value(CASE WHEN starts_with(text, '#') THEN text END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM parts)"""


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty lines to a page; every other page has white space around it."""
    lines = fx.files(spark, sf).select("document_id", F.split("text", "\n").alias("lines"))
    cut = lines.select("document_id", "lines", F.explode(F.sequence(F.lit(0), F.expr("(size(lines) - 1) div 20"))).alias("p"))
    return cut.select("document_id", (F.col("p") + 1).cast("int").alias("page_number"), F.array_join(F.slice("lines", F.col("p") * 20 + 1, F.lit(20)), "\n").alias("text")).withColumn("text", F.when(F.col("page_number") % 2 == 1, F.concat(F.lit(" \t"), "text", F.lit("\n "))).otherwise(F.col("text")))


PAGES_SQL = rf"""{FI}, lined AS (SELECT document_id, string_split(text, chr(10)) AS lines FROM files), cut AS (SELECT document_id, lines, unnest(range((len(lines) - 1) // 20 + 1)) AS p FROM lined),
pages AS (SELECT document_id, CAST(p + 1 AS INTEGER) AS page_number, CASE WHEN p % 2 = 0 THEN concat(' ', chr(9), t, chr(10), ' ') ELSE t END AS text FROM (SELECT *, array_to_string(lines[p * 20 + 1 : p * 20 + 20], chr(10)) AS t FROM cut)),
found AS (SELECT document_id, page_number, 0 AS place, 'title' AS type, 'DOCUMENT TITLE: ' || (list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''))[1] AS text FROM pages WHERE page_number = 1
  UNION ALL SELECT document_id, page_number, 1, 'text', regexp_replace(text, '^\s+|\s+$', '', 'g') FROM pages WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> '')"""


def hits(spark: SparkSession, sf: str) -> DataFrame:
    chunks = fx.chunks(spark, sf)
    ranked = search.top_k(chunks, fx.vector_queries(spark, sf), 5)
    page = F.when(F.col("vec_id") % 3 != 0, F.col("page_number"))
    return ranked.join(chunks.select("vec_id", "document_id", "filename", page.alias("page_number"), "chunk_type", "department", "content", F.when(F.col("vec_id") % 2 == 0, "v1").alias("version")), "vec_id")


HITS_SQL = f"""{C}, {S}, hits AS (SELECT query_id, vec_id, document_id, filename, CASE WHEN vec_id % 3 <> 0 THEN page_number END AS page_number, chunk_type, department, content, CASE WHEN vec_id % 2 = 0 THEN 'v1' END AS version, score, rank
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored) WHERE rank <= 5)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, question, answer, cited, reference, context, ground_truth): a user's turn, the answer to it, the conversation's last turn, the six turns before with the question (and in every other conversation the answer)."""
    c = fx.conversations(spark, sf)
    last = c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("reference"))
    by = Window.partitionBy("conv_id").orderBy("turn")
    said = c.withColumns({"answer": F.lead("text").over(by), "who": F.lead("role").over(by), "before": F.array_join(F.collect_list("text").over(by.rowsBetween(-6, 0)), "\n")}).filter("role = 'user' and who = 'assistant'")
    cited = F.when(F.col("turn") % 5 != 4, F.concat(F.col("answer"), F.lit(" [Source 1: "), F.regexp_extract("answer", r"(\S+)", 1), F.lit(", Page 2] [Source 2: zz"), F.col("conv_id"), F.lit("]"))).otherwise(F.col("answer"))
    context = F.when(F.col("conv_id") % 2 == 0, F.concat_ws("\n", "before", "answer")).otherwise(F.col("before"))
    return said.join(last, "conv_id").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("question"), "answer", cited.alias("cited"), "reference", context.alias("context"), F.when(F.col("conv_id") % 3 != 0, F.col("reference")).alias("ground_truth"))


PAIRS_SQL = r"""last AS (SELECT conv_id, arg_max(text, turn) AS reference FROM conversations GROUP BY conv_id),
said AS (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS who, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), chr(10)) AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id * 100 + turn AS query_id, text AS question, answer, CASE WHEN turn % 5 <> 4 THEN concat(answer, ' [Source 1: ', regexp_extract(answer, '(\S+)', 1), ', Page 2] [Source 2: zz', conv_id, ']') ELSE answer END AS cited, reference, CASE WHEN conv_id % 2 = 0 THEN concat_ws(chr(10), before, answer) ELSE before END AS context, CASE WHEN conv_id % 3 <> 0 THEN reference END AS ground_truth
  FROM said JOIN last USING (conv_id) WHERE role = 'user' AND who = 'assistant')"""
_STOPS = ", ".join(f"'{w}'" for w in metrics.stop_words())


def _topics(text: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOPS}))"


def _n(words: str) -> str:
    return f"map_from_entries(list_transform(list_distinct({words}), lambda w: struct_pack(k := w, v := len(list_filter({words}, lambda z: z = w)))))"


def similarity_sql(x: str, y: str) -> str:
    """Of two count maps (columns)."""
    norm = lambda a, b: f"sqrt(list_sum(list_transform(map_keys({a}), lambda w: ({a}[w] * CASE WHEN map_contains({b}, w) THEN 1.0::DOUBLE ELSE 1.4054651081081644::DOUBLE END) ** 2)))"
    return f"CASE WHEN cardinality({x}) = 0 OR cardinality({y}) = 0 THEN 0.0::DOUBLE ELSE coalesce(list_sum(list_transform(map_keys({x}), lambda w: CAST({x}[w] * coalesce({y}[w], 0) AS DOUBLE))) / ({norm(x, y)} * {norm(y, x)}), 0) END"


COUNTED_SQL = f"""{PAIRS_SQL}, counted AS (SELECT *, {_n('tq')} AS q, {_n('ta')} AS a, {_n('tc')} AS c, {_n('tr')} AS r FROM (SELECT *, {_topics('question')} AS tq, {_topics('answer')} AS ta, {_topics('context')} AS tc, {_topics('reference')} AS tr FROM pairs))"""
FAITHFUL_SQL = rf"""{COUNTED_SQL}, sentences AS (SELECT query_id, unnest(list_filter(list_transform(regexp_split_to_array(answer, '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')) AS s FROM pairs),
scored AS (SELECT query_id, {_n('ts')} AS s FROM (SELECT query_id, {_topics('s')} AS ts FROM sentences)),
faithful AS (SELECT p.query_id, coalesce(avg(CASE WHEN s IS NULL THEN NULL WHEN {similarity_sql('scored.s', 'p.c')} >= 0.4 THEN 1.0::DOUBLE ELSE 0 END), 0) AS faithfulness FROM counted p LEFT JOIN scored USING (query_id) GROUP BY p.query_id)"""
HALLUCINATED_SQL = f"""numbers AS (SELECT *, list_distinct(regexp_extract_all(answer, '[0-9]+')) AS x, regexp_extract_all(context, '[0-9]+') AS y FROM counted),
hallucinated_ AS (SELECT query_id, coalesce(len(list_filter(x, lambda v: NOT list_contains(y, v))) / nullif(len(x), 0)::DOUBLE > 0.3, false) OR {similarity_sql('a', 'c')} < 0.3 AS hallucinated FROM numbers)"""
CITED_SQL = r"""cites AS (SELECT query_id, context, regexp_extract_all(cited, '\[Source [0-9]+: ([^\]]+)\]', 1) AS cs FROM pairs),
cited_ AS (SELECT query_id, CASE WHEN len(cs) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(cs, lambda c: contains(context, c) OR len(list_filter(list_filter(regexp_split_to_array(c, '\s+'), lambda w: w <> '')[1:2], lambda w: contains(context, w))) > 0)) / len(cs)::DOUBLE END AS citation_accuracy FROM cites)"""
_W = lambda c: rf"list_filter(regexp_split_to_array(lower({c}), '\s+'), lambda w: w <> '')"
_R = lambda c: f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


def _grams(w: str, n: int) -> str:
    return f"CASE WHEN len({w}) < {n} THEN [] ELSE list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i : i + {n - 1}], ' ')) END"


def _clipped(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda g: least(len(list_filter({a}, lambda z: z = g)), len(list_filter({b}, lambda z: z = g))))), 0)"


def bleu_sql(source: str) -> str:
    """BLEU as CTEs up to ``bleu_`` (query_id, bleu), from a select of (query_id, reference, answer)."""
    grams = ", ".join(f'{_grams("r", n)} AS r{n}, {_grams("h", n)} AS h{n}' for n in range(1, 5))
    found = ", ".join(f'{_clipped(f"h{n}", f"r{n}")} AS m{n}, greatest(len(h{n}), 1) AS t{n}' for n in range(1, 5))
    logs = " + ".join(f"ln((CASE WHEN m{n} = 0 THEN 0.1::DOUBLE ELSE m{n}::DOUBLE END) / t{n})" for n in range(1, 5))
    return f"""bleu_w AS (SELECT query_id, {_W('reference')} AS r, {_W('answer')} AS h FROM ({source})), bleu_g AS (SELECT query_id, r, h, {grams} FROM bleu_w),
bleu_m AS (SELECT query_id, len(r) AS nr, len(h) AS nh, {found} FROM bleu_g),
bleu_ AS (SELECT query_id, CASE WHEN m1 = 0 THEN 0.0::DOUBLE ELSE CASE WHEN nh > nr THEN 1.0::DOUBLE ELSE exp(1 - nr / nh::DOUBLE) END * exp(({logs}) / 4) END AS bleu FROM bleu_m)"""


def rouge_l_sql(source: str) -> str:
    """ROUGE-L as CTEs up to ``rouge_`` (query_id, rouge_l): one row of the table of common subsequences a step; a cell is the greatest of all that may be carried to it."""
    cell = "greatest(row[j + 1], CASE WHEN r[j] = h[i + 1] THEN row[j] + 1 ELSE 0 END)"
    return f"""lcs_w AS (SELECT query_id, {_R('reference')} AS r, {_R('answer')} AS h FROM ({source})),
lcs_fold AS (
  SELECT query_id, 0 AS i, list_transform(range(len(r) + 1), lambda x: 0) AS row FROM lcs_w
  UNION ALL SELECT query_id, i + 1, list_concat([0], list_transform(range(1, len(c) + 1), lambda j: CAST(list_max(c[1:j]) AS INTEGER)))
  FROM (SELECT query_id, i, list_transform(range(1, len(r) + 1), lambda j: CAST({cell} AS INTEGER)) AS c FROM lcs_fold JOIN lcs_w USING (query_id) WHERE i < len(h))
),
rouge_ AS (SELECT query_id, coalesce(2 * (n / nh) * (n / nr) / nullif(n / nh + n / nr, 0), 0) AS rouge_l FROM (SELECT query_id, coalesce(row[len(r) + 1], 0)::DOUBLE AS n, nullif(len(h), 0) AS nh, nullif(len(r), 0) AS nr FROM lcs_fold JOIN lcs_w USING (query_id) WHERE i = len(h)))"""


BLEU_SQL = f"WITH {PAIRS_SQL}, {bleu_sql('SELECT query_id, reference, answer FROM pairs')} SELECT query_id, round(bleu, 6) AS bleu FROM bleu_"
ROUGE_SQL = f"""WITH {PAIRS_SQL}, w AS (SELECT query_id, {_R('reference')} AS r, {_R('answer')} AS h FROM pairs), g AS (SELECT query_id, r, h, {_grams('r', 2)} AS r2, {_grams('h', 2)} AS h2 FROM w), m AS (SELECT query_id, len(r) AS nr, len(h) AS nh, len(r2) AS nr2, len(h2) AS nh2, {_clipped('h', 'r')}::DOUBLE AS m1, {_clipped('h2', 'r2')}::DOUBLE AS m2 FROM g)
SELECT query_id, round(coalesce(2 * (m1 / nullif(nh, 0)) * (m1 / nullif(nr, 0)) / nullif(m1 / nullif(nh, 0) + m1 / nullif(nr, 0), 0), 0), 6) AS rouge1, round(coalesce(2 * (m2 / nullif(nh2, 0)) * (m2 / nullif(nr2, 0)) / nullif(m2 / nullif(nh2, 0) + m2 / nullif(nr2, 0), 0), 0), 6) AS rouge2 FROM m"""


def _pair(**columns):
    """Metrics of pairs, rounded to six digits."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        made = {n: c() for n, c in columns.items()}
        kinds = [(F.round(c, 6) if n not in ("hallucinated",) else c).alias(n) for n, c in made.items()]
        return pairs(spark, sf).select("query_id", *kinds)

    return query


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return tb.clean(fx.tables(spark, sf))


_CELL = r"regexp_replace(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
CLEAN_SQL = f"""{T}, headed AS (SELECT table_id, name, CASE WHEN len(list_filter(hs, lambda h: h <> '')) > 0 THEN hs ELSE list_transform(range(1, list_max(list_transform(rows, lambda r: len(r))) + 1), lambda i: concat('Column_', i)) END AS headers, rows
  FROM (SELECT *, list_transform(headers, lambda h: {_CELL.format('h')}) AS hs FROM tables_)),
clean AS (SELECT table_id, name, headers, list_filter(list_transform(rows, lambda r: list_resize(list_transform(r, lambda c: {_CELL.format('c')}), len(headers), '')), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS rows FROM headed),
cells AS (SELECT table_id, name, headers, row_idx, row, unnest(range(len(row))) AS col, unnest(row) AS cell FROM (SELECT table_id, name, headers, unnest(range(len(rows))) AS row_idx, unnest(rows) AS row FROM clean)),
lines AS (SELECT table_id, name, row_idx, concat('Row ', row_idx + 1, ':', chr(10), string_agg(concat('@@', headers[col + 1], ': ', cell), chr(10) ORDER BY col), chr(10)) AS t FROM cells GROUP BY table_id, name, row_idx),
texts AS (SELECT table_id, concat(CASE WHEN name <> '' THEN concat('Table: ', name, chr(10), chr(10)) ELSE '' END, string_agg(t, chr(10) ORDER BY row_idx)) AS content FROM lines GROUP BY table_id, name)"""
MD_SQL = f"""WITH {CLEAN_SQL} SELECT table_id, concat(CASE WHEN name <> '' THEN concat('### ', name, chr(10), chr(10)) ELSE '' END, '| ', array_to_string(headers, ' | '), ' |', chr(10), '| ', array_to_string(list_transform(headers, lambda h: '---'), ' | '), ' |', chr(10), array_to_string(list_transform(rows, lambda r: concat('| ', array_to_string(list_transform(r, lambda c: replace(c, '|', '\\|')), ' | '), ' |')), chr(10))) AS content FROM clean"""
RECORDS_SQL = r"""SELECT table_id, CAST(row_idx AS INTEGER) AS row_idx, key, CASE WHEN cell = '' THEN 'string' WHEN regexp_matches(plain, '^[+-]?[0-9]+$') THEN 'int' WHEN try_cast(plain AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'string' END AS type, CASE WHEN regexp_matches(plain, '^[+-]?[0-9]+$') THEN CAST(CAST(plain AS BIGINT) AS VARCHAR) ELSE cell END AS value
  FROM (SELECT *, regexp_replace(regexp_replace(replace(cell, ',', ''), '([0-9])_([0-9])', '\1\2', 'g'), '^\s+|\s+$', '', 'g') AS plain FROM (SELECT table_id, row_idx, replace(replace(lower(headers[col + 1]), ' ', '_'), '-', '_') AS key, arg_max(cell, col) AS cell FROM cells GROUP BY ALL))"""


def packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_blocks(blocks(spark, sf), 120, 25, 30)


def sentence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_sentences(fx.files(spark, sf), 120, 25)


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all files with their metadata, and a table chunk for each file of one type."""
    files = fx.files(spark, sf)
    text = chunking.chunk_records(packing.pack_blocks(blocks(spark, sf)), files)
    tables = files.filter("file_type = 'md'").select("document_id", F.lit("table").alias("chunk_type"), F.lit(1).alias("row_count"))
    return chunking.combined(text, tables)


_STRIP = lambda t: rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"
_SPLIT = lambda t: rf"string_split(regexp_replace({t}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def _overlap(text: str, overlap: int) -> str:
    """The longest run of whole sentences at the end that fits: the first of all runs that do, longest first."""
    runs = f"list_transform(range(1, len({_SPLIT(text)}) + 1), lambda o: concat(array_to_string(({_SPLIT(text)})[o:], ' '), ' '))"
    return f"CASE WHEN {text} = '' THEN '' ELSE coalesce(list_filter({runs}, lambda z: length(z) // 4 <= {overlap})[1], '') END"


def sentences_sql(source: str, size: int, overlap: int) -> str:
    """Packing by sentences, and by words where one is too long, as CTEs up to ``packed_sentences`` (id, step, part, content), from a select of (id, text); one sentence, or word, a step."""
    return rf"""split_ AS (SELECT id, {_SPLIT('text')} AS ss FROM ({source})),
sents AS (SELECT id, unnest(ss) AS s, unnest(range(len(ss))) AS k, len(ss) AS n FROM split_),
longs AS (SELECT row_number() OVER () AS n, s, list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '') AS ws FROM (SELECT DISTINCT s FROM sents WHERE length(s) // 4 > {size})),
word_fold AS (
  SELECT n, 0 AS i, '' AS cur, NULL::VARCHAR AS done FROM longs
  UNION ALL SELECT n, i + 1, CASE WHEN full_ THEN w ELSE longer END, CASE WHEN full_ AND cur <> '' THEN cur END
  FROM (SELECT *, length(longer) // 4 >= {size} AS full_ FROM (SELECT f.n, i, cur, ws[i + 1] AS w, CASE WHEN cur = '' THEN ws[i + 1] ELSE concat(cur, ' ', ws[i + 1]) END AS longer FROM word_fold f JOIN longs USING (n) WHERE i < len(ws)))
),
word_parts AS (
  SELECT s, list_concat(coalesce(list(done ORDER BY i) FILTER (done IS NOT NULL), []), list(cur) FILTER (i = len(ws) AND cur <> '')) AS parts FROM word_fold JOIN longs USING (n) GROUP BY s
),
sentence_fold AS (
  SELECT id, 0::BIGINT AS i, '' AS cur, []::VARCHAR[] AS done FROM split_
  UNION ALL SELECT id, i + 1,
    CASE WHEN length(longer) // 4 <= {size} THEN longer WHEN length(s) // 4 > {size} THEN '' ELSE concat({_overlap('cur', overlap)}, s, ' ') END,
    CASE WHEN length(longer) // 4 <= {size} THEN [] ELSE list_concat(CASE WHEN cur <> '' THEN [{_STRIP('cur')}] ELSE [] END, CASE WHEN length(s) // 4 > {size} THEN coalesce(parts, []) ELSE [] END) END
  FROM (SELECT x.*, w.parts FROM (SELECT f.id, i, cur, s, concat(cur, s, ' ') AS longer FROM sentence_fold f JOIN sents t ON t.id = f.id AND t.k = f.i) x LEFT JOIN word_parts w ON w.s = x.s AND length(x.s) // 4 > {size})
),
packed_sentences AS (
  SELECT id, i AS step, unnest(range(len(done))) AS part, unnest(done) AS content FROM sentence_fold
  UNION ALL SELECT id, i + 1, 0, {_STRIP('cur')} FROM sentence_fold JOIN split_ USING (id) WHERE i = len(ss) AND {_STRIP('cur')} <> ''
)"""


def blocks_sql(size: int, overlap: int, least: int) -> str:
    """Packing of blocks as CTEs up to ``chunks_`` (document_id, chunk_index, content, pages, sections), one block a step."""
    piece = lambda t, split="false": f"[struct_pack(t := {t}, p := pages, s := sections, split := {split})]"
    closed = f"CASE WHEN enough THEN {piece(_STRIP('cur'))} ELSE [] END"
    return f"""{BLOCKS_SQL}, placed AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY block_idx) - 1 AS i, type, text, [page_number] AS page, CASE WHEN section = '' THEN [] ELSE [section] END AS section FROM blocks),
block_fold AS (
  SELECT DISTINCT document_id, 0::BIGINT AS i, '' AS cur, []::INTEGER[] AS pages, []::VARCHAR[] AS sections, []::STRUCT(t VARCHAR, p INTEGER[], s VARCHAR[], split BOOLEAN)[] AS done FROM placed
  UNION ALL SELECT document_id, i + 1,
    CASE WHEN type = 'heading' THEN concat(text, chr(10), chr(10)) WHEN fits THEN longer WHEN large THEN '' ELSE concat({_overlap('cur', overlap)}, text, chr(10), chr(10)) END,
    CASE WHEN type = 'heading' THEN page WHEN fits THEN CASE WHEN list_contains(pages, page[1]) THEN pages ELSE list_concat(pages, page) END WHEN large THEN [] ELSE page END,
    CASE WHEN type = 'heading' THEN section WHEN fits THEN CASE WHEN len(section) = 0 OR list_contains(sections, section[1]) THEN sections ELSE list_concat(sections, section) END WHEN large THEN [] ELSE section END,
    CASE WHEN type = 'heading' THEN CASE WHEN enough THEN {piece('cur')} ELSE [] END WHEN fits THEN [] WHEN large THEN list_concat({closed}, [struct_pack(t := text, p := page, s := section, split := true)]) ELSE {closed} END
  FROM (SELECT f.document_id, f.i, cur, pages, sections, type, text, page, section, concat(cur, text, chr(10), chr(10)) AS longer, cur <> '' AND length(cur) // 4 >= {least} AS enough,
    length(concat(cur, text, chr(10), chr(10))) // 4 <= {size} AS fits, length(text) // 4 > {size} AS large FROM block_fold f JOIN placed b ON b.document_id = f.document_id AND b.i = f.i)
),
pieces AS (
  SELECT document_id, i AS step, unnest(range(len(done))) AS part, unnest(done) AS c FROM block_fold
  UNION ALL SELECT document_id, i + 1, 0, struct_pack(t := {_STRIP('cur')}, p := pages, s := sections, split := false) FROM block_fold f WHERE i = (SELECT count(*) FROM placed b WHERE b.document_id = f.document_id) AND cur <> '' AND length(cur) // 4 >= {least}
),
numbered AS (SELECT row_number() OVER () AS id, document_id, step, part, c FROM pieces),
{sentences_sql('SELECT id, c.t AS text FROM numbered WHERE c.split', size, overlap)},
found_ AS (
  SELECT document_id, step, part, 0 AS inner_step, 0 AS inner_part, c.t AS content, c.p AS pages, c.s AS sections FROM numbered WHERE NOT c.split
  UNION ALL SELECT document_id, n.step, n.part, q.step, q.part, q.content, c.p, c.s FROM numbered n JOIN packed_sentences q USING (id)
),
chunks_ AS (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY step, part, inner_step, inner_part) - 1 AS INTEGER) AS chunk_index, content, pages, sections FROM found_)"""


QUERIES = {
    "p1_paragraphs": lambda spark, sf: chunking.paragraphs(marked(spark, sf)),
    "p2_page_blocks": lambda spark, sf: chunking.page_blocks(pages(spark, sf)),
    "p3_sections": lambda spark, sf: blocks(spark, sf).select("document_id", "block_idx", "section"),
    "p6_document_stats": lambda spark, sf: chunking.document_stats(blocks(spark, sf), blocks(spark, sf).filter("block_idx % 5 = 3").select("document_id")),
    "t1_t2_clean_table": lambda spark, sf: clean(spark, sf).select("table_id", "name", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "~")), "\n").alias("rows")),
    "t3_row_text_indented": lambda spark, sf: clean(spark, sf).select("table_id", tb.row_text("  ").alias("content")),
    "t4_row_text": lambda spark, sf: clean(spark, sf).select("table_id", tb.row_text().alias("content")),
    "t5_records": lambda spark, sf: tb.records(clean(spark, sf)),
    "t6_markdown": lambda spark, sf: clean(spark, sf).select("table_id", tb.markdown().alias("content")),
    "t7_summary": lambda spark, sf: clean(spark, sf).select("table_id", tb.summary_line().alias("summary")),
    "t8_table_chunk": lambda spark, sf: tb.table_chunks(clean(spark, sf)).select("table_id", "chunk_type", "row_count", F.md5("content").alias("content_md5")),
    "t9_row_chunks": lambda spark, sf: tb.row_chunks(clean(spark, sf)).select("table_id", "row_range", "content"),
    "k1_token_count": lambda spark, sf: fx.files(spark, sf).select("document_id", chunking.count_tokens(F.col("text")).alias("tokens")),
    "k2_pack_blocks": lambda spark, sf: packed(spark, sf).select("document_id", "chunk_index", "content", F.array_join(F.col("page_numbers").cast("array<string>"), ",").alias("page_numbers"), F.array_join("sections", "|").alias("sections"), "token_count"),
    "k3_k5_sentence_chunks": sentence_chunks,
    "k6_chunk_records": lambda spark, sf: records(spark, sf).select("document_id", "chunk_id", "chunk_type", "filename", "department", "token_count", "row_count"),
    "k7_ingest_counts": lambda spark, sf: chunking.ingest_counts(fx.files(spark, sf), records(spark, sf)),
    "e1_prefix": lambda spark, sf: fx.files(spark, sf).select("document_id", F.md5(embed.with_prefix(F.col("text"), "bge-m3")).alias("with_prefix"), F.md5(embed.with_prefix(F.col("text"), "other")).alias("without")),
    "e2_hashed_vectors": lambda spark, sf: fx.conversations(spark, sf).select("conv_id", "turn", F.transform(embed.hashed_vector(F.col("text"), 16), lambda x: F.round(x, 6)).alias("v")).select("conv_id", "turn", *[F.element_at("v", i + 1).alias(f"v{i}") for i in (0, 3, 7, 15)]),
    "x1_context": lambda spark, sf: context.contexts(hits(spark, sf)),
    "x2_short_context": lambda spark, sf: context.contexts(hits(spark, sf), short=True),
    "x3_sources": lambda spark, sf: context.sources(hits(spark, sf)),
    "m6_bleu": _pair(bleu=lambda: metrics.bleu(F.col("reference"), F.col("answer"))),
    "m7_rouge": _pair(rouge1=lambda: metrics.rouge_n(F.col("reference"), F.col("answer"), 1), rouge2=lambda: metrics.rouge_n(F.col("reference"), F.col("answer"), 2)),
    "m7_rouge_stemmed": _pair(rouge1=lambda: metrics.rouge_n(F.col("reference"), F.col("answer"), 1, stems=True), rouge2=lambda: metrics.rouge_n(F.col("reference"), F.col("answer"), 2, stems=True), rouge_l=lambda: metrics.rouge_l(F.col("reference"), F.col("answer"), stems=True)),
    "m7_rouge_l": _pair(rouge_l=lambda: metrics.rouge_l(F.col("reference"), F.col("answer"))),
    "m8_m9_similarity": _pair(similarity=lambda: metrics.similarity(F.col("answer"), F.col("context")), relevancy=lambda: metrics.similarity(F.col("question"), F.col("answer"))),
    "m10_faithfulness": _pair(faithfulness=lambda: metrics.faithfulness(F.col("answer"), F.col("context"))),
    "m14_hallucination": _pair(hallucinated=lambda: metrics.hallucinated(F.col("answer"), F.col("context"))),
    "m15_citations": _pair(citation_accuracy=lambda: metrics.citation_accuracy(F.col("cited"), F.col("context"))),
    "m16_correctness": _pair(correctness=lambda: metrics.correctness(F.col("answer"), F.col("ground_truth"), F.col("context"))),
}

SQL = {
    "p1_paragraphs": f"WITH {BLOCKS_SQL} SELECT document_id, CAST(block_idx AS INTEGER) AS block_idx, type, text FROM blocks",
    "p2_page_blocks": f"WITH {PAGES_SQL} SELECT document_id, page_number, type, text, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_number, place) - 1 AS INTEGER) AS block_idx FROM found WHERE text IS NOT NULL",
    "p3_sections": f"WITH {BLOCKS_SQL} SELECT document_id, CAST(block_idx AS INTEGER) AS block_idx, section FROM blocks",
    "p6_document_stats": f"WITH {BLOCKS_SQL} SELECT document_id, count(*) AS blocks, count(*) FILTER (type = 'heading') AS headings, count(*) FILTER (type = 'paragraph') AS paragraph_count, count(*) FILTER (block_idx % 5 = 3) AS table_count, max(page_number) AS page_count, CAST(sum(length(text)) AS BIGINT) AS character_count FROM blocks GROUP BY document_id",
    "t1_t2_clean_table": f"WITH {CLEAN_SQL} SELECT table_id, name, array_to_string(headers, '|') AS headers, array_to_string(list_transform(rows, lambda r: array_to_string(r, '~')), chr(10)) AS rows FROM clean",
    "t3_row_text_indented": f"WITH {CLEAN_SQL} SELECT table_id, replace(content, '@@', '  ') AS content FROM texts",
    "t4_row_text": f"WITH {CLEAN_SQL} SELECT table_id, replace(content, '@@', '') AS content FROM texts",
    "t5_records": f"WITH {CLEAN_SQL} {RECORDS_SQL}",
    "t6_markdown": MD_SQL,
    "t7_summary": f"WITH {CLEAN_SQL} SELECT table_id, concat('Table ''', name, ''' with ', len(headers), ' columns (', array_to_string(headers[1:3], ', '), CASE WHEN len(headers) > 3 THEN '...' ELSE '' END, ') and ', len(rows), ' rows') AS summary FROM clean",
    "t8_table_chunk": f"WITH {CLEAN_SQL} SELECT table_id, 'table' AS chunk_type, CAST(len(rows) AS INTEGER) AS row_count, md5(replace(content, '@@', '')) AS content_md5 FROM texts JOIN clean USING (table_id)",
    "t9_row_chunks": f"WITH {CLEAN_SQL}, parts AS (SELECT table_id, name, row_idx // 5 AS p, min(row_idx) + 1 AS first, max(row_idx) + 1 AS last, string_agg(t, chr(10) ORDER BY row_idx) AS body FROM lines WHERE table_id IN (SELECT table_id FROM clean WHERE len(rows) > 10) GROUP BY ALL) SELECT table_id, concat(first, '-', last) AS row_range, concat('Table: ', name, ' (Rows ', first, '-', last, ')', chr(10), chr(10), replace(body, '@@', '')) AS content FROM parts",
    "k1_token_count": f"WITH {FI} SELECT document_id, CAST(length(text) // 4 AS INTEGER) AS tokens FROM files",
    "k2_pack_blocks": f"WITH RECURSIVE {blocks_sql(120, 25, 30)} SELECT document_id, chunk_index, content, array_to_string(pages, ',') AS page_numbers, array_to_string(sections, '|') AS sections, CAST(length(content) // 4 AS INTEGER) AS token_count FROM chunks_",
    "k6_chunk_records": f"WITH RECURSIVE {blocks_sql(500, 50, 100)} SELECT document_id, concat(document_id, '_', chunk_index) AS chunk_id, 'text' AS chunk_type, filename, department, CAST(length(content) // 4 AS INTEGER) AS token_count, NULL::INTEGER AS row_count FROM chunks_ JOIN files USING (document_id) UNION ALL SELECT document_id, NULL, 'table', NULL, NULL, NULL, 1 FROM files WHERE file_type = 'md'",
    "k7_ingest_counts": f"WITH RECURSIVE {blocks_sql(500, 50, 100)}, n AS (SELECT document_id, count(*) AS n FROM chunks_ GROUP BY document_id) SELECT document_id, coalesce(n, 0) AS text_chunks, CAST(file_type = 'md' AS BIGINT) AS table_chunks, CASE WHEN coalesce(n, 0) + CAST(file_type = 'md' AS BIGINT) > 0 THEN 'success' ELSE 'warning' END AS status FROM files LEFT JOIN n USING (document_id)",
    "e1_prefix": f"WITH {FI} SELECT document_id, md5(concat('{embed.PREFIXES['query']}', text)) AS with_prefix, md5(text) AS without FROM files",
    "e2_hashed_vectors": r"WITH b AS (SELECT conv_id, turn, list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda w: CAST(concat('0x', substring(md5(w), 1, 8)) AS BIGINT) % 16) AS b FROM conversations), v AS (SELECT conv_id, turn, list_transform(range(16), lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE) AS v FROM b), n AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM v) SELECT conv_id, turn, "
    + ", ".join(f"round(CASE WHEN n > 0 THEN v[{i + 1}] / n ELSE v[{i + 1}] END, 6) AS v{i}" for i in (0, 3, 7, 15))
    + " FROM n",
    "x1_context": f"WITH {HITS_SQL} SELECT query_id, string_agg(concat('[Source ', rank, ': ', filename, ', ', concat_ws(' | ', concat('Page ', coalesce(CAST(page_number AS VARCHAR), 'N/A'), CASE WHEN chunk_type = 'table' THEN ', Type: Table' ELSE '' END), concat('Dept: ', department), CASE WHEN version IS NOT NULL THEN concat('Version: ', version) END), ']', chr(10), content, chr(10)), concat(chr(10), '---', chr(10)) ORDER BY rank) AS context FROM hits GROUP BY query_id",
    "x2_short_context": f"WITH {HITS_SQL} SELECT query_id, string_agg(concat('[Source ', rank, ': ', filename, ']', chr(10), content, chr(10)), concat(chr(10), '---', chr(10)) ORDER BY rank) AS context FROM hits GROUP BY query_id",
    "x3_sources": f"WITH {HITS_SQL} SELECT query_id, rank, substring(content, 1, 500) AS content, document_id, filename AS document_name, page_number, chunk_type, score AS relevance_score FROM hits",
    "m6_bleu": BLEU_SQL,
    "m7_rouge": ROUGE_SQL,
    "m8_m9_similarity": f"WITH {COUNTED_SQL} SELECT query_id, round({similarity_sql('a', 'c')}, 6) AS similarity, round({similarity_sql('q', 'a')}, 6) AS relevancy FROM counted",
    "m10_faithfulness": f"WITH {FAITHFUL_SQL} SELECT query_id, round(faithfulness, 6) AS faithfulness FROM faithful",
    "m7_rouge_l": f"WITH RECURSIVE {PAIRS_SQL}, {rouge_l_sql('SELECT query_id, reference, answer FROM pairs')} SELECT query_id, round(rouge_l, 6) AS rouge_l FROM rouge_",
    "m14_hallucination": f"WITH {COUNTED_SQL}, {HALLUCINATED_SQL} SELECT query_id, hallucinated FROM hallucinated_",
    "m15_citations": r"WITH "
    + PAIRS_SQL
    + r", k AS (SELECT query_id, context, regexp_extract_all(cited, '\[Source [0-9]+: ([^\]]+)\]', 1) AS cs FROM pairs) SELECT query_id, round(CASE WHEN len(cs) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(cs, lambda c: contains(context, c) OR len(list_filter(list_filter(regexp_split_to_array(c, '\s+'), lambda w: w <> '')[1:2], lambda w: contains(context, w))) > 0)) / len(cs)::DOUBLE END, 6) AS citation_accuracy FROM k",
    "m16_correctness": f"WITH {FAITHFUL_SQL} SELECT query_id, round(CASE WHEN coalesce(ground_truth, '') <> '' THEN {similarity_sql('a', 'r')} ELSE faithfulness END, 6) AS correctness FROM counted JOIN faithful USING (query_id)",
}
