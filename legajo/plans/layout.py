"""Words with boxes: lines, blocks, low-confidence words and regions.

The boxes are synthetic arithmetic over the page texts: a line's top is 20
times its number, a word's left ten times the characters before it, its height
10 to 15.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legajo.functions.quality import field_like, heading_like, low_confidence, noise_line
from legajo.functions.text import SPACE, round_half_up
from legajo.operators import layout as op
from legajo.plans.registry import query
from legajo.sources.tsv import parse_words
from legajo.tables import spread, table

_WORDS = f"""
SELECT doc, 1 AS page, block, paragraph, line, word_no, text, CAST((doc * 31 + line * 17 + word_no * 7) % 101 AS DOUBLE) AS confidence, CAST("left" AS DOUBLE) AS "left", CAST(line * 20.0 + block * 10.0 AS DOUBLE) AS top, CAST(length(text) * 10.0 AS DOUBLE) AS width, CAST(10 + (doc * 3 + line * 7 + word_no * 5) % 6 AS DOUBLE) AS height FROM (
  SELECT doc, CAST(line AS INTEGER) AS line, CAST(1 + line // 4 AS INTEGER) AS block, CAST(1 + line // 2 AS INTEGER) AS paragraph, CAST(w AS INTEGER) AS word_no, words[w] AS text,
    (line % 3) * 30.0 + 10.0 * (length(array_to_string(words[1:w - 1], ' ')) + CASE WHEN w > 1 THEN 1 ELSE 0 END) AS "left" FROM (
    SELECT doc, line, words, unnest(generate_series(1, len(words))) AS w FROM (
      SELECT doc, line, list_filter(string_split(trim(regexp_replace(t, '[{SPACE}]+', ' ', 'g')), ' '), lambda x: x <> '') AS words FROM (
        SELECT page_id AS doc, unnest(generate_series(1, len(regexp_split_to_array(text, '\\r?\\n')))) AS line, unnest(regexp_split_to_array(text, '\\r?\\n')) AS t FROM quality_inputs WHERE text IS NOT NULL))))
"""


def _split_words(line: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(line, f"[{SPACE}]+", " ")), " "), lambda x: x != "")


def _boxed(doc: Column, line: Column, own: Column, w: Column, text: Column) -> dict[str, Column]:
    """The columns of word ``w`` (from 0) of the words ``own`` of a line."""
    before = F.length(F.array_join(F.slice(own, F.lit(1), w), " ")) + F.when(w > 0, 1).otherwise(0)
    n, block = w + 1, (1 + F.floor(line / 4)).cast("int")
    return {
        "doc": doc, "page": F.lit(1), "block": block, "paragraph": (1 + F.floor(line / 2)).cast("int"), "line": line, "word_no": n, "text": text,
        "confidence": ((doc * 31 + line * 17 + n * 7) % 101).cast("double"), "left": (line % 3) * 30.0 + 10.0 * before,
        "top": line * 20.0 + (1 + F.floor(line / 4)) * 10.0, "width": F.length(text) * 10.0, "height": (10 + (doc * 3 + line * 7 + n * 5) % 6).cast("double"),
    }


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "quality_inputs").where("text is not null").select("page_id", "text"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _texts(spark, sf_dir).select(F.col("page_id").alias("doc"), F.posexplode(F.split("text", "\r?\n")).alias("p", "t"))
    parts = line.select("doc", (F.col("p") + 1).alias("line"), _split_words(F.col("t")).alias("words"))
    word = parts.select("doc", "line", "words", F.posexplode("words").alias("w", "text"))
    return word.select(*[c.alias(k) for k, c in _boxed(*[F.col(c) for c in ("doc", "line", "words", "w", "text")]).items()])


_LINES = f"""
SELECT doc, page, block, paragraph, line, string_agg(text, ' ' ORDER BY "left", word_no) AS text, min("left") AS "left", min(top) AS top, max("left" + width) - min("left") AS width, max(top + height) - min(top) AS height, avg(confidence) AS mean_confidence, count(*) AS words
FROM ({_WORDS}) GROUP BY ALL
"""


@query(f'SELECT doc, line, text, "left", top, width, height, round(mean_confidence, 6) AS mean_confidence, words FROM ({_LINES})')
def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.word_lines(words(spark, sf_dir)).select("doc", "line", "text", "left", "top", "width", "height", F.round("mean_confidence", 6).alias("mean_confidence"), "words")


_ORDER = f'SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY top, "left", block, paragraph, line) AS reading_no FROM ({_LINES})'


@query(f"SELECT doc, line, CAST(reading_no AS INTEGER) AS reading_no FROM ({_ORDER})")
def reading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.reading_order(op.word_lines(words(spark, sf_dir))).select("doc", "line", "reading_no")


_LEN = "len(regexp_extract_all({x}, '{p}'))"
_TOKENS = f"len(list_filter(string_split(trim(regexp_replace({{x}}, '[ \\t\\n\\r]+', ' ', 'g')), ' '), lambda v: v <> ''))"
_HEADING = f"({_LEN.format(x='text', p=chr(92) + 'p{L}')} >= 4 AND {_TOKENS.format(x='text')} <= 9 AND {_LEN.format(x='text', p=chr(92) + 'p{Lu}')} >= 0.88 * {_LEN.format(x='text', p=chr(92) + 'p{L}')})"
_LABEL = "trim(split_part(text, ':', 1))"
_FIELD = f"(strpos(text, ':') - 1 > 0 AND {_TOKENS.format(x=_LABEL)} BETWEEN 1 AND 5 AND length({_LABEL}) <= 48 AND regexp_full_match({_LABEL}, '[\\p{{L}} ._-]+') AND strpos(text, ':') - 1 < 0.55 * length(text) AND {_TOKENS.format(x='text')} <= 18)"


@query(f"SELECT doc, line, {_HEADING} AS heading_like, {_FIELD} AS field_like FROM ({_LINES})")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = op.word_lines(words(spark, sf_dir))
    return lines.select("doc", "line", heading_like(F.col("text")).alias("heading_like"), field_like(F.col("text")).alias("field_like"))


_BLOCKS = f"""
SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc, page ORDER BY reading_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS layout_block FROM (
 SELECT *, CASE WHEN pl IS NULL OR top - (pt + ph) > 1.1 * mh OR (abs("left" - pl) > 2.5 * mh AND least(width, pw) < 0.85 * greatest(width, pw)) OR special OR ps OR block <> pb OR paragraph <> pp THEN 1 ELSE 0 END AS fresh FROM (
  SELECT *, lag("left") OVER w AS pl, lag(top) OVER w AS pt, lag(width) OVER w AS pw, lag(height) OVER w AS ph, lag(special) OVER w AS ps, lag(block) OVER w AS pb, lag(paragraph) OVER w AS pp FROM (
   SELECT *, ({_HEADING} AND width > 0) OR {_FIELD} AS special, greatest(1, list_sort(list(height) OVER (PARTITION BY doc))[count(*) OVER (PARTITION BY doc) // 2 + 1]) AS mh FROM ({_ORDER})) WINDOW w AS (PARTITION BY doc, page ORDER BY reading_no)))
"""
_BLOCK_ROWS = f"""
SELECT doc, page, layout_block, string_agg(text, chr(10) ORDER BY reading_no) AS text, min("left") AS "left", min(top) AS top, max("left" + width) - min("left") AS width, max(top + height) - min(top) AS height,
  round(sum(mean_confidence * words) / sum(words), 6) AS mean_confidence, count(*) AS lines FROM ({_BLOCKS}) GROUP BY ALL
"""


@query(f'SELECT doc, layout_block, text, "left", top, width, height, mean_confidence, lines FROM ({_BLOCK_ROWS})')
def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.block_rows(op.word_lines(words(spark, sf_dir)))
    return rows.select("doc", "layout_block", "text", "left", "top", "width", "height", F.round("mean_confidence", 6).alias("mean_confidence"), "lines")




def noise_sql(x: str) -> str:
    """The noise-line predicate over the SQL expression ``x``."""
    t = f"trim(regexp_replace(coalesce({x}, ''), '^[{SPACE}]+|[{SPACE}]+$', '', 'g'))"
    solid, signs = f"len(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}]'))", f"len(regexp_extract_all({t}, '[^\\p{{L}}\\p{{N}}\\s]'))"
    sizes = f"list_transform(list_filter(string_split(trim(regexp_replace({t}, '[{SPACE}]+', ' ', 'g')), ' '), lambda v: v <> ''), lambda v: length(regexp_replace(v, '^[\\p{{P}}\\p{{S}}]+|[\\p{{P}}\\p{{S}}]+$', '', 'g')))"
    return f"({t} = '' OR ({solid} BETWEEN 1 AND 6 AND {signs} > 0.45 * ({solid} + {signs})) OR (len({sizes}) >= 4 AND len(list_filter({sizes}, lambda s: s <= 2)) >= 0.75 * len({sizes}) AND len(list_filter({sizes}, lambda s: s >= 4)) = 0))"


@query(f"""
WITH b AS (SELECT *, {noise_sql('text')} AS noise FROM ({_BLOCK_ROWS})), k AS (SELECT *, bool_and(noise) OVER (PARTITION BY doc) AS all_noise FROM b)
SELECT doc, count(*) AS blocks, bool_or(mean_confidence < 50) AS needs_review FROM k WHERE NOT noise OR all_noise GROUP BY doc
""")
def layout_review_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks without noise ones (all of them where nothing else is left), and
    whether any asks for review."""
    rows = op.block_rows(op.word_lines(words(spark, sf_dir))).withColumn("noise", noise_line(F.col("text")))
    own = rows.groupBy("doc").agg(F.bool_and("noise").alias("all"), F.count("*").alias("n"), F.count_if(~F.col("noise")).alias("kept"), F.bool_or(F.col("mean_confidence") < 50).alias("any"), F.bool_or((F.col("mean_confidence") < 50) & ~F.col("noise")).alias("kept_any"))
    return own.select("doc", F.when(F.col("all"), F.col("n")).otherwise(F.col("kept")).alias("blocks"), F.when(F.col("all"), F.col("any")).otherwise(F.col("kept_any")).alias("needs_review"))


@query(f"""
SELECT page_id, part, array_to_string(list_transform(list_filter(regexp_split_to_array(p, '(\\r?\\n)[ \\t\\r]*(\\r?\\n)(\\s*\\n)*'), lambda b: trim(b) <> ''), lambda b: trim(regexp_replace(b, '[{SPACE}]+', ' ', 'g'))), chr(10) || chr(10)) AS text FROM (
  SELECT page_id, CAST(unnest(generate_series(1, len(string_split(text, chr(12))))) AS INTEGER) AS part, unnest(string_split(text, chr(12))) AS p FROM quality_inputs WHERE text IS NOT NULL) WHERE trim(regexp_replace(p, '[{SPACE}]+', ' ', 'g')) <> ''
""")
def paragraph_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of non-blank lines as paragraphs, page by page (form feeds part
    pages, blank pages are dropped)."""
    part = table(spark, sf_dir, "quality_inputs").where("text is not null").select("page_id", F.posexplode(F.split("text", "\f")).alias("n", "p")).where(F.trim(F.regexp_replace("p", f"[{SPACE}]+", " ")) != "")
    blocks = F.filter(F.split("p", r"(\r?\n)[ \t\r]*(\r?\n)(\s*\n)*"), lambda b: F.trim(b) != "")
    return part.select("page_id", (F.col("n") + 1).alias("part"), F.array_join(F.transform(blocks, lambda b: F.trim(F.regexp_replace(b, f"[{SPACE}]+", " "))), "\n\n").alias("text"))


@query(f"""
SELECT doc, line, word_no, text, confidence, 'p' || page || '-w' || row_number() OVER (PARTITION BY doc, page ORDER BY line, word_no) AS word_id FROM ({_WORDS}) WHERE confidence >= 0 AND confidence < 50
""")
def low_confidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-confidence words numbered among themselves on their page."""
    low = words(spark, sf_dir).where(low_confidence(F.col("confidence")))
    number = F.row_number().over(Window.partitionBy("doc", "page").orderBy("line", "word_no"))
    return low.select("doc", "line", "word_no", "text", "confidence", F.concat(F.lit("p"), F.col("page"), F.lit("-w"), number).alias("word_id"))


@query(f"""
SELECT w.doc, w.line, w.word_no, w.text, l.text AS line_text FROM ({_WORDS}) w JOIN ({_LINES}) l USING (doc, page, block, paragraph, line) WHERE w.confidence >= 0 AND w.confidence < 50
""")
def low_confidence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each low-confidence word with the text of its own line: the line is built
    by the same grouping, so its words are kept in it and no join is needed."""
    own = words(spark, sf_dir).groupBy(*op.LINE).agg(F.array_sort(F.collect_list(F.struct("left", "word_no", "text", "confidence"))).alias("w"))
    line = F.array_join(F.transform("w", lambda x: x["text"]), " ")
    low = F.filter("w", lambda x: low_confidence(x["confidence"]))
    return own.select("doc", "line", line.alias("line_text"), F.explode(low).alias("x")).select("doc", "line", "x.word_no", "x.text", "line_text")


@query(f"SELECT doc, line, word_no, text, confidence FROM ({_WORDS}) ORDER BY confidence, doc, line, word_no LIMIT 5")
def lowest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five words of lowest confidence (top-k report)."""
    return words(spark, sf_dir).select("doc", "line", "word_no", "text", "confidence").orderBy("confidence", "doc", "line", "word_no").limit(5)


_REGION = "SELECT doc, line, \"left\", top, width, height FROM (" + _LINES + ")"


@query(f"""
SELECT doc, line, greatest(0, "left" - px) AS crop_left, greatest(0, top - py) AS crop_top, least(2000, "left" + width + px) - greatest(0, "left" - px) AS crop_width, least(3000, top + height + py) - greatest(0, top - py) AS crop_height
FROM (SELECT *, greatest(12, round_even(0.02 * width, 0)) AS px, greatest(10, round_even(0.15 * height, 0)) AS py FROM ({_REGION}))
""")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded boxes clamped to the image (halves rounded to even)."""
    box = op.word_lines(words(spark, sf_dir)).withColumns({"px": F.greatest(F.lit(12.0), F.bround(0.02 * F.col("width"))), "py": F.greatest(F.lit(10.0), F.bround(0.15 * F.col("height")))})
    left, top = F.greatest(F.lit(0.0), F.col("left") - F.col("px")), F.greatest(F.lit(0.0), F.col("top") - F.col("py"))
    return box.select("doc", "line", left.alias("crop_left"), top.alias("crop_top"), (F.least(F.lit(2000.0), F.col("left") + F.col("width") + F.col("px")) - left).alias("crop_width"), (F.least(F.lit(3000.0), F.col("top") + F.col("height") + F.col("py")) - top).alias("crop_height"))


@query(f"""
SELECT doc, line, x0 AS region_left, y0 AS region_top, x1 - x0 AS region_width, y1 - y0 AS region_height, (x1 - x0) * (y1 - y0) <= 2000000 AND x1 - x0 >= 1 AND y1 - y0 >= 1 AS acceptable
FROM (SELECT doc, line, greatest(0, floor("left" - px)) AS x0, greatest(0, floor(top - py)) AS y0, least(2000, ceil("left" + width + px)) AS x1, least(3000, ceil(top + height + py)) AS y1
  FROM (SELECT *, greatest(16, floor(2 * height + 0.5)) AS px, greatest(12, floor(1.5 * height + 0.5)) AS py FROM ({_REGION}) WHERE width > 0 AND height > 0))
""")
def review_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions for a second reading (halves rounded up), and whether a request
    for them is acceptable."""
    box = op.word_lines(words(spark, sf_dir)).where("width > 0 and height > 0")
    box = box.withColumns({"px": F.greatest(F.lit(16), round_half_up(2 * F.col("height"))), "py": F.greatest(F.lit(12), round_half_up(1.5 * F.col("height")))})
    box = box.select("doc", "line", F.greatest(F.lit(0), F.floor(F.col("left") - F.col("px"))).alias("x0"), F.greatest(F.lit(0), F.floor(F.col("top") - F.col("py"))).alias("y0"), F.least(F.lit(2000), F.ceil(F.col("left") + F.col("width") + F.col("px"))).alias("x1"), F.least(F.lit(3000), F.ceil(F.col("top") + F.col("height") + F.col("py"))).alias("y1"))
    out = box.select("doc", "line", *[F.col(c).cast("double").alias(n) for c, n in (("x0", "region_left"), ("y0", "region_top"))], (F.col("x1") - F.col("x0")).cast("double").alias("region_width"), (F.col("y1") - F.col("y0")).cast("double").alias("region_height"))
    return out.withColumn("acceptable", (F.col("region_width") * F.col("region_height") <= 2_000_000) & (F.col("region_width") >= 1) & (F.col("region_height") >= 1))


@query(f"SELECT doc, CAST(page AS INTEGER) AS page, line, word_no, text, confidence, \"left\", top, width, height FROM ({_WORDS})")
def tsv_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as recogniser TSV and read again: the scan gives back every
    word with its box."""
    lines = F.transform(F.split("text", "\r?\n"), lambda t, p: F.struct((p + 1).alias("line"), _split_words(t).alias("words")))
    page = _texts(spark, sf_dir).select(F.col("page_id").alias("doc"), lines.alias("lines"))

    def row(x: Column, w: Column, of: Column) -> Column:
        own = _boxed(F.col("doc"), of["line"], of["words"], w, x)
        return F.concat_ws("\t", F.lit("5"), *[own[c].cast("string") for c in ("page", "block", "paragraph", "line", "word_no", "left", "top", "width", "height", "confidence", "text")])

    rows = F.flatten(F.transform("lines", lambda of: F.transform(of["words"], lambda x, w: row(x, w, of))))
    header = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    tsv = page.select("doc", F.concat(F.lit(header + "\n"), F.array_join(rows, "\n")).alias("tsv"))
    return parse_words(tsv, "tsv").select("doc", "page", "line", "word_no", "text", "confidence", "left", "top", "width", "height")


@query(f"""
SELECT doc, string_agg('<rect x="' || CAST(CAST("left" AS INTEGER) AS VARCHAR) || '" y="' || CAST(CAST(top AS INTEGER) AS VARCHAR) || '" stroke="' || CASE WHEN mean_confidence >= 50 THEN 'green' ELSE 'red' END || '"/>', chr(10) ORDER BY line) AS svg FROM ({_LINES}) GROUP BY doc
""")
def overlay_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page's lines as drawing, green where confidence is half or more."""
    rect = F.format_string('<rect x="%d" y="%d" stroke="%s"/>', F.col("left").cast("int"), F.col("top").cast("int"), F.when(F.col("mean_confidence") >= 50, "green").otherwise("red"))
    own = op.word_lines(words(spark, sf_dir)).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("line", rect.alias("r")))).alias("r"))
    return own.select("doc", F.array_join(F.transform("r", lambda x: x["r"]), "\n").alias("svg"))


_INK = f'SELECT doc, line AS row_no, sum(width) AS ink, min("left") AS x0, max("left" + width) AS x1 FROM ({_WORDS}) GROUP BY doc, line'


def _bands_sql(rows: str, keys: str, window: str, least: str, gap: str) -> str:
    equal = " AND ".join(f"b.{k} = r.{k}" for k in keys.split(", "))
    mean = lambda k: f"sum(ink) OVER (PARTITION BY {keys} ORDER BY row_no RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING) / {2 * k + 1}"
    own = ", ".join(f"b.{k}" for k in keys.split(", "))
    return f"""
WITH r AS ({rows}), s AS (SELECT *, CASE {window} WHEN 3 THEN {mean(1)} WHEN 5 THEN {mean(2)} ELSE {mean(3)} END AS smooth FROM r),
a AS (SELECT *, row_no - row_number() OVER (PARTITION BY {keys} ORDER BY row_no) AS run FROM s WHERE smooth >= {least}),
u AS (SELECT {keys}, run, min(row_no) AS y0, max(row_no) + 1 AS y1, any_value({gap}) AS g FROM a GROUP BY {keys}, run HAVING max(row_no) + 1 - min(row_no) >= 2),
n AS (SELECT *, CASE WHEN y0 - lag(y1) OVER w <= g THEN 0 ELSE 1 END AS fresh FROM u WINDOW w AS (PARTITION BY {keys} ORDER BY y0)),
d AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY y0) AS band FROM n), b AS (SELECT {keys}, band, min(y0) AS y0, max(y1) AS y1 FROM d GROUP BY {keys}, band)
SELECT {own}, b.y0, b.y1, sum(r.ink) AS ink, max(r.x1) - min(r.x0) AS width FROM b JOIN r ON {equal} AND r.row_no >= b.y0 AND r.row_no < b.y1 AND r.ink > 0 GROUP BY {own}, b.y0, b.y1 HAVING sum(r.ink) >= 600 AND max(r.x1) - min(r.x0) >= 100 AND b.y1 - b.y0 >= 2
"""


def _ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink of each text line of a page, with its extent (lines stand for image rows)."""
    return words(spark, sf_dir).groupBy("doc", F.col("line").alias("row_no")).agg(F.sum("width").alias("ink"), F.min("left").alias("x0"), F.max(F.col("left") + F.col("width")).alias("x1"))


@query(_bands_sql(_INK, "doc", "3", "200", "1"))
def ink_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of rows whose smoothed ink passes a threshold, small gaps bridged,
    slight ones left out."""
    return op.ink_bands(_ink(spark, sf_dir), ["doc"], F.lit(3), F.lit(200), F.lit(1), 2, 600, 100, 2)


#: Grid of the search: ink a row needs, share of the page's widest row it needs, window, gap.
GRID = {"threshold": (100, 300), "ratio": (0.2, 0.4, 0.6), "span": (3, 5), "max_gap": (1, 2)}
_GRID_ROWS = f"SELECT i.*, threshold, ratio, span, max_gap, max(ink) OVER (PARTITION BY doc, threshold, ratio, span, max_gap) AS widest FROM ({_INK}) i, " + ", ".join(f"(VALUES {', '.join(f'({v})' for v in vs)}) v_{k}({k})" for k, vs in GRID.items())


@query(f"""
WITH b AS ({_bands_sql(_GRID_ROWS, 'doc, threshold, ratio, span, max_gap', 'span', 'greatest(threshold, ratio * widest)', 'max_gap')}),
h AS (SELECT doc, threshold, CAST(ratio AS DOUBLE) AS ratio, span, max_gap, list(y1 - y0) AS h, median(y1 - y0) AS m FROM b GROUP BY ALL),
e AS (SELECT page_id AS doc, 1 + len(regexp_extract_all(trim(text, chr(10)), chr(10) || '\\s*' || chr(10))) AS expected FROM quality_inputs WHERE text IS NOT NULL),
s AS (SELECT h.*, list_sum(list_transform(h, lambda x: abs(x - m))) AS score FROM h JOIN e USING (doc) WHERE len(h.h) = expected)
SELECT doc, threshold, ratio, span, max_gap, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score, threshold, ratio, span, max_gap) AS k FROM s) WHERE k = 1
""")
def grid_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid search over four parameters: those that find as many bands as the
    page has paragraphs, of the most even heights."""
    grid = [F.explode(F.array(*[F.lit(v) for v in vs])).alias(k) for k, vs in GRID.items()]
    rows = _ink(spark, sf_dir).withColumn("widest", F.max("ink").over(Window.partitionBy("doc")))
    for g in grid:
        rows = rows.select("*", g)
    keys = ["doc", *GRID]
    bands = op.ink_bands(rows, keys, F.col("span"), F.greatest(F.col("threshold"), F.col("ratio") * F.col("widest")), F.col("max_gap"), 2, 600, 100, 2)
    page = table(spark, sf_dir, "quality_inputs").where("text is not null")
    expected = page.select(F.col("page_id").alias("doc"), (1 + F.regexp_count(F.trim(F.col("text"), F.lit("\n")), F.lit("\n\\s*\n"))).alias("expected"))
    return op.best_parameters(bands, "doc", list(GRID), expected)


@query()
def region_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line boxes of a page grouped by running mean centre."""
    lines = op.word_lines(words(spark, sf_dir))
    regions = lines.select("doc", F.col("line").cast("long").alias("region_no"), "left", (F.col("top") * 0.7).alias("top"), "width", "height")
    return op.region_groups(regions)
