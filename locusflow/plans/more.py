"""More queries on the test tables: vocabularies, databases of sets, order and
pages, transcripts, and operators that other queries only use inside."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusflow.functions import digests
from locusflow.operators import alignments, classification, coverage, databases, enrichment, nomenclature, ranges, scoring, statistics, transcripts, vocabulary
from locusflow.plans.catalog import _LOLA, _SEG, _SEQ, _contingency, _islands, _sequences, _track, query, transform_sql

C = F.col

# row-wise, order and pages


@query(transform_sql("start", "start + 20"))
def resize_start(t):
    return ranges.resize(t.a, 20)


@query(transform_sql('greatest(0, "end" - 20)', '"end"'))
def resize_end(t):
    return ranges.resize(t.a, 20, "end")


@query(transform_sql('"end"', '"end" + 15'))
def flank_end(t):
    return ranges.flank(t.a, 15, use_start=False)


@query("SELECT id, chr, start, \"end\" FROM iv_a WHERE chr IN ('chr2', 'chr7', 'chrX')")
def on_chromosomes(t):
    return ranges.on_chromosomes(t.a, ["chr2", "chr7", "chrX"])


@query("SELECT DISTINCT chr FROM iv_a")
def chromosomes(t):
    return ranges.chromosomes(t.a)


@query('SELECT id, row_number() OVER (ORDER BY chr, start, "end") - 1 AS ord FROM iv_a')
def sorted_rows(t):
    return ranges.numbered(t.a).select("id", "ord")


@query('SELECT id, o AS ord FROM (SELECT id, row_number() OVER (ORDER BY chr, start, "end") - 1 AS o, count(*) OVER () AS n FROM iv_a) WHERE o >= n - 25 AND o < n - 5')
def rows_by_index(t):
    return ranges.rows_between(ranges.numbered(t.a), -25, -5).select("id", "ord")


@query("""WITH c AS (SELECT DISTINCT chr FROM iv_a UNION SELECT unnest(['chrX', 'chrM', 'chrUn_1', 'chrY', '3'])), k AS (SELECT chr, regexp_replace(chr, '^chr', '') AS n FROM c)
SELECT chr, row_number() OVER (ORDER BY CASE WHEN try_cast(n AS INTEGER) IS NOT NULL THEN 0 WHEN n = 'X' THEN 1 WHEN n = 'Y' THEN 2 WHEN n IN ('M', 'MT') THEN 3 ELSE 4 END, coalesce(try_cast(n AS INTEGER), 0), n, chr) AS place FROM k""")
def karyotype_order(t):
    from pyspark.sql import Window

    more = t.spark.createDataFrame([(c,) for c in ("chrX", "chrM", "chrUn_1", "chrY", "3")], "chr string")
    names = ranges.chromosomes(t.a).union(more).distinct()  # a row a chromosome
    return names.select("chr", F.row_number().over(Window.orderBy(*ranges.karyotype_key("chr"), "chr")).cast("long").alias("place"))


@query("SELECT chr, list_aggregate(list_sort(list(start + (\"end\" - start) // 2)), 'string_agg', ',') AS mids FROM iv_b GROUP BY chr")
def midpoints_by_chromosome(t):
    return t.b.groupBy("chr").agg(F.array_join(F.transform(F.array_sort(F.collect_list(ranges.midpoint())), lambda m: m.cast("string")), ",").alias("mids"))


@query("""WITH a AS (SELECT chr, start, "end", row_number() OVER (ORDER BY id) AS ord FROM iv_b)
SELECT a.ord AS ord, CAST(greatest(0, a.start - b."end", b.start - a."end") AS BIGINT) AS gap FROM a JOIN a b ON b.ord = a.ord + 1""")
def gap_distances(t):
    from locusflow.operators.primitives import ranked

    b = ranked(t.b.select("start", "end", "id"), [], "id", ["id"], "ord")
    q, s = (b.select((C("ord") - k).alias("ord"), C("start").alias(f"{p}start"), C("end").alias(f"{p}end")) for k, p in ((0, "q_"), (1, "s_")))
    return q.join(s, "ord").select("ord", ranges.gap_distance("q_", "s_").alias("gap"))


# set operations and statistics


@query(f"""WITH x AS (SELECT DISTINCT chr, start + 25 AS start, "end" + 30 AS "end", strand FROM iv_b WHERE id % 3 = 0), ra AS ({_islands("iv_b", "chr, strand")}), rb AS ({_islands("x", "chr, strand")}),
pos AS (SELECT chr, strand, start AS p FROM ra UNION SELECT chr, strand, "end" FROM ra UNION SELECT chr, strand, start FROM rb UNION SELECT chr, strand, "end" FROM rb),
seg AS (SELECT chr, strand, p AS start, lead(p) OVER (PARTITION BY chr, strand ORDER BY p) AS "end" FROM pos),
kept AS (SELECT chr, strand, start, "end" FROM seg s WHERE "end" IS NOT NULL AND EXISTS (SELECT 1 FROM ra a WHERE a.chr = s.chr AND a.strand = s.strand AND a.start <= s.start AND a."end" >= s."end")
  AND NOT EXISTS (SELECT 1 FROM rb b WHERE b.chr = s.chr AND b.strand = s.strand AND b.start <= s.start AND b."end" >= s."end"))
{_islands("kept", "chr, strand")}""")
def setdiff_stranded(t):
    x = t.b.filter("id % 3 = 0").withColumn("start", C("start") + 25).withColumn("end", C("end") + 30)
    return ranges.setdiff(t.b, x, ["chr", "strand"])


@query(f"""WITH u AS ({_islands("sets")}), c AS (SELECT u.chr AS chr, u.start AS start, u."end" AS "end", count(DISTINCT s.set_id) AS count FROM u JOIN sets s ON s.chr = u.chr AND s.start < u."end" AND s."end" > u.start GROUP BY ALL)
SELECT * FROM c WHERE count >= 2""")
def consensus_of_two(t):
    return statistics.consensus(t.sets).filter("count >= 2")


@query(_SEG + """ SELECT 1 - CAST(sum("end" - start) FILTER (in_a AND NOT in_b) AS BIGINT) / CAST(sum("end" - start) FILTER (in_a) AS BIGINT) AS coverage FROM flag""")
def coverage_of(t):
    return statistics.coverage_of(t.a, t.b)


@query("""WITH i AS (SELECT set_id, md5(md5(string_agg(chr, ',' ORDER BY chr, start, "end")) || ',' || md5(string_agg(CAST(start AS VARCHAR), ',' ORDER BY chr, start, "end")) || ',' || md5(string_agg(CAST("end" AS VARCHAR), ',' ORDER BY chr, start, "end"))) AS identifier FROM sets GROUP BY set_id)
SELECT md5(string_agg(identifier, '' ORDER BY identifier)) AS identifier FROM i""")
def list_identifier(t):
    return digests.list_identifier(digests.set_identifiers(t.sets, ["set_id"]))


@query("""SELECT md5(string_agg(chr || chr(9) || start || chr(9) || "end" || chr(10), '' ORDER BY chr, start, "end")) AS digest FROM iv_b""")
def file_digest(t):
    return digests.file_digest(t.b)


@query(_SEQ + """ SELECT doc_id, CASE WHEN regexp_full_match(seq, '[ACGT]*') THEN 'dna2bit' WHEN regexp_full_match(seq, '[ACGTNRYX]*') THEN 'dna3bit' ELSE 'other' END AS dna,
  CASE WHEN regexp_full_match(upper(coalesce(source, '')), '[ACGT]*') THEN 'dna2bit' WHEN regexp_full_match(upper(coalesce(source, '')), '[ACGTNRYX]*') THEN 'dna3bit' WHEN regexp_full_match(upper(coalesce(source, '')), '[ACGTNRYKMSWBDHVX*-]*') THEN 'dnaio' WHEN regexp_full_match(upper(coalesce(source, '')), '[ACDEFGHIKLMNPQRSTVWYX*-]*') THEN 'protein' ELSE 'ascii' END AS name
FROM d JOIN documents USING (doc_id)""")
def alphabets(t):
    s = _sequences(t, source=F.coalesce("source", F.lit(""))).filter("doc_id is not null")
    return s.select("doc_id", digests.alphabet(C("seq")).alias("dna"), digests.alphabet(C("source")).alias("name"))


@query(_track('SELECT chr, greatest(1, "end" - 3) AS pos, 1 AS d FROM iv_a UNION ALL SELECT chr, "end" + 3 + 1, -1 FROM iv_a'))
def end_coverage(t):
    return coverage.runs(coverage.point_events(t.a, "end", 3))


@query(f"""WITH track AS ({_track('SELECT chr, start + 1 AS pos, 1 AS d FROM iv_a UNION ALL SELECT chr, "end", -1 FROM iv_a')}),
g AS (SELECT chr, "end" AS start, lead(start) OVER (PARTITION BY chr ORDER BY start) AS "end" FROM track)
SELECT * FROM track UNION ALL SELECT chr, start, "end", 0 FROM g WHERE "end" > start AND "end" - start <= 30""")
def filled_coverage(t):
    return coverage.filled(coverage.runs(coverage.core_events(t.a)), 30)


# enrichment and databases


@query(_LOLA + """, s AS (SELECT *, a / greatest(a + c, 1) AS p, CASE WHEN b * c = 0 THEN CAST('nan' AS DOUBLE) ELSE (a * d) / (b * c) END AS o FROM x),
r AS (SELECT user_set, set_id, rank() OVER (PARTITION BY user_set ORDER BY p DESC) AS rnk_pv, rank() OVER (PARTITION BY user_set ORDER BY isnan(o), CASE WHEN isnan(o) THEN 0 ELSE o END DESC) AS rnk_or, rank() OVER (PARTITION BY user_set ORDER BY a DESC) AS rnk_sup FROM s)
SELECT *, greatest(rnk_pv, rnk_or, rnk_sup) AS max_rnk, round((rnk_pv + rnk_or + rnk_sup) / 3, 3) AS mean_rnk FROM r""")
def enrichment_ranks(t):
    """Ranks by plain figures that SQL has too, in place of the test's."""
    x = _contingency(t)
    odds = F.when(C("b") * C("c") == 0, float("nan")).otherwise(C("a") * C("d") / (C("b") * C("c")))
    r = enrichment.ranked(x.withColumn("p_value_log", C("a") / F.greatest(C("a") + C("c"), F.lit(1))).withColumn("odds_ratio", odds))
    return r.select("user_set", "set_id", *[C(n).cast("long").alias(n) for n in ("rnk_pv", "rnk_or", "rnk_sup", "max_rnk")], "mean_rnk")


@query("""WITH u AS (SELECT chr, start, "end" FROM iv_a UNION ALL SELECT chr, start, "end" FROM iv_b), pos AS (SELECT chr, start AS p FROM u UNION SELECT chr, "end" FROM u), seg AS (SELECT chr, p AS start, lead(p) OVER (PARTITION BY chr ORDER BY p) AS "end" FROM pos)
SELECT chr, start, "end" FROM seg WHERE "end" IS NOT NULL AND EXISTS (SELECT 1 FROM u a WHERE a.chr = seg.chr AND a.start <= seg.start AND a."end" >= seg."end")""")
def restricted_universe(t):
    return enrichment.restricted_universe(t.a.select("chr", "start", "end").unionByName(t.b.select("chr", "start", "end")))


def _database(t) -> databases.RegionDB:
    return databases.RegionDB.from_sets(t.sets, t.set_ids.select("set_id", F.concat(F.lit("line_"), "set_id").alias("filename")))


@query("""WITH h AS (SELECT s.set_id AS set_id, count(*) AS pairs, count(DISTINCT q.id) AS queries FROM iv_b q JOIN sets s ON q.chr = s.chr AND s.start < q."end" AND s."end" > q.start GROUP BY s.set_id), n AS (SELECT set_id, count(*) AS size FROM sets WHERE start < "end" GROUP BY set_id)
SELECT set_id, 'line_' || set_id AS filename, size, pairs, queries FROM h JOIN n USING (set_id)""")
def database_search(t):
    return _database(t).search(t.b)


@query("""WITH n AS (SELECT set_id, count(*) AS size FROM sets WHERE start < "end" GROUP BY set_id), k AS (SELECT max(set_id) + 1 AS k FROM sets)
SELECT set_id, 'line_' || set_id AS filename, size FROM n UNION ALL SELECT set_id + k, 'line_' || set_id, size FROM n, k""")
def database_merge(t):
    db = _database(t)
    both = db.merge(db)
    return both.list().join(both.sizes(), "set_id").select("set_id", "filename", "size")


@query("SELECT s.set_id AS set_id, s.chr AS chr, s.start AS start, s.\"end\" AS \"end\" FROM sets s WHERE set_id IN (2, 5) AND start < \"end\"")
def database_get(t):
    return _database(t).get(["line_2", "line_5", "none"]).drop("filename")


@query(_LOLA + """, z AS (SELECT set_id, count(*) AS size FROM sets WHERE start < "end" GROUP BY set_id) SELECT user_set, set_id, a, 'line_' || set_id AS filename, size FROM x JOIN z USING (set_id)""")
def annotated_results(t):
    return _database(t).annotate(_contingency(t)).select("user_set", "set_id", "a", "filename", "size")


# vocabularies


_VOCABULARY = """WITH u AS (SELECT chr, start, "end", min(id) AS ord, max(id % 17) AS score FROM iv_b GROUP BY ALL), v AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS token, chr || ':' || start || '-' || "end" AS name FROM u), k AS (SELECT count(*) AS n FROM v),
special AS (SELECT n + i AS token, '<' || s || '>' AS name FROM k, (SELECT unnest(['unk', 'pad', 'mask', 'cls', 'eos', 'bos', 'sep']) AS s, unnest(range(7)) AS i))"""


def _tokenizer(t) -> vocabulary.Tokenizer:
    return vocabulary.Tokenizer(vocabulary.vocabulary(t.b.select("chr", "start", "end", C("id").alias("ord"), (C("id") % 17).cast("double").alias("score"))))


@query(_VOCABULARY + " SELECT token, name FROM v UNION ALL SELECT token, name FROM special")
def vocabulary_table(t):
    return _tokenizer(t).table.select("token", "name")


@query(_VOCABULARY + " SELECT row_number() OVER (ORDER BY score DESC, ord) - 1 AS token, name FROM v")
def vocabulary_by_score(t):
    rows = t.b.select("chr", "start", "end", C("id").alias("ord"), (C("id") % 17).cast("double").alias("score"))
    return vocabulary.vocabulary(rows, by_score=True).filter("chr is not null").select("token", "name")


@query(_VOCABULARY + ' SELECT a.id AS id, v.token AS token FROM iv_a a JOIN v ON a.chr = v.chr AND a.start < v."end" AND a."end" > v.start')
def encode_regions(t):
    return _tokenizer(t).encode(t.a)


@query(_VOCABULARY + ' SELECT a.id AS id, v.name AS name FROM iv_a a JOIN v ON a.chr = v.chr AND a.start < v."end" AND a."end" > v.start')
def tokenize_regions(t):
    return _tokenizer(t).tokenize(t.a).select("id", "name")


@query(_VOCABULARY + ", q AS (SELECT o_orderkey AS token FROM orders), w AS (SELECT token, name FROM v UNION ALL SELECT token, name FROM special) SELECT q.token AS token, coalesce(name, '<unk>') AS name, coalesce(name, '<unk>') LIKE '<%>' AS special FROM q LEFT JOIN w USING (token)")
def decode_tokens(t):
    z = _tokenizer(t)
    return z.decode(t.read("orders").select(C("o_orderkey").alias("token"))).withColumn("special", z.special_mask())


@query(_VOCABULARY + ", w AS (SELECT token, name FROM v UNION ALL SELECT token, name FROM special) SELECT id AS name, token FROM iv_a LEFT JOIN w ON name = id")
def token_ids(t):
    return _tokenizer(t).tokens_of(t.a.select(C("id").alias("name")))


@query(_VOCABULARY + " SELECT (SELECT count(*) FROM v) + 7 AS size")
def vocabulary_size(t):
    return _tokenizer(t).size()


# genes: an order is a transcript, its lines are the exons


_TX = """WITH e AS (SELECT l_orderkey AS tx, l_linenumber * 1000 AS s, l_linenumber * 1000 + CAST(max(l_quantity) AS BIGINT) + 5 AS e, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM lineitem GROUP BY l_orderkey, l_linenumber),
o AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY tx ORDER BY CASE WHEN strand = '+' THEN s ELSE -s END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)"""


def _transcripts(t):
    l = t.read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    start = (C("l_linenumber") * 1000).cast("long")
    e = F.struct(start.alias("start"), (start + C("l_quantity").cast("long") + 5).alias("end"))
    x = l.groupBy(C("l_orderkey").alias("tx")).agg(F.collect_list(e).alias("exons"))
    strand = F.when(C("tx") % 2 == 0, "+").otherwise("-")
    return x.select("tx", F.lit("chr1").alias("chr"), strand.alias("strand"), "exons", F.lit(1003).cast("long").alias("cds_start"), F.array_max(F.transform("exons", lambda x: x["end"])).alias("cds_end"), (C("tx") % 5).alias("gene"), (C("tx") < 5).alias("mane"))


@query(_TX + " SELECT tx, CAST(sum(e - s) AS BIGINT) AS length, CAST(sum(greatest(e - greatest(s, 1003), 0)) AS BIGINT) AS coding FROM o GROUP BY tx")
def transcript_lengths(t):
    return transcripts.indexed(_transcripts(t)).select("tx", "length", transcripts.coding_length().alias("coding"))


@query(_TX + ", p AS (SELECT tx, unnest([1000, 1004, 1900, 2010, 3020, 4030]) AS position FROM (SELECT DISTINCT tx FROM e)) SELECT p.tx AS tx, position, CAST(before + CASE WHEN strand = '+' THEN position - s ELSE e - 1 - position END AS BIGINT) AS \"offset\" FROM p LEFT JOIN o ON p.tx = o.tx AND s <= position AND position < e")
def transcript_offsets(t):
    x = _transcripts(t)
    p = x.select("tx", F.explode(F.array(*[F.lit(n).cast("long") for n in (1000, 1004, 1900, 2010, 3020, 4030)])).alias("position"))
    return transcripts.from_genome(p, x)


@query(_TX + ", n AS (SELECT tx, unnest([1, 12, 40, 90]) AS number FROM (SELECT DISTINCT tx FROM e)) SELECT n.tx AS tx, number, CAST(CASE WHEN strand = '+' THEN s + number - 1 - before ELSE e - 1 - (number - 1 - before) END AS BIGINT) AS position FROM n LEFT JOIN o ON n.tx = o.tx AND before < number AND number <= before + e - s")
def transcript_positions(t):
    x = _transcripts(t)
    p = x.select("tx", F.explode(F.array(*[F.lit(n).cast("long") for n in (1, 12, 40, 90)])).alias("number"))
    p = p.select("tx", F.lit("n").alias("kind"), "number", F.lit(False).alias("after_stop"), F.lit(0).cast("long").alias("intronic"))
    return transcripts.to_genome(p, x).select("tx", "number", "position")


@query("""WITH n AS (SELECT CASE n_nationkey % 8 WHEN 0 THEN 'NM_' WHEN 1 THEN 'chr' WHEN 2 THEN 'GL0' WHEN 3 THEN 'GL' WHEN 4 THEN 'ENST' ELSE '' END || n_name || CASE WHEN n_nationkey % 7 = 6 THEN '.2' ELSE '' END AS name FROM nation)
SELECT name, NOT (contains(name, '.') OR name = 'MT' OR starts_with(name, 'NM_') OR starts_with(name, 'ENST') OR starts_with(name, 'chr') OR regexp_matches(name, '^(GL|KI)[0-9]')) AS gene FROM n""")
def gene_symbols(t):
    k = C("n_nationkey") % 8
    head = F.when(k == 0, "NM_").when(k == 1, "chr").when(k == 2, "GL0").when(k == 3, "GL").when(k == 4, "ENST").otherwise("")
    name = F.concat(head, "n_name", F.when(C("n_nationkey") % 7 == 6, ".2").otherwise(""))
    return t.read("nation").select(name.alias("name")).select("name", nomenclature.gene_symbol(C("name")).alias("gene"))


@query("""SELECT 'bed6+2' AS compliance, 'bed_like_rs' AS format, 6 AS compliant_columns, 2 AS other_columns""")
def classified(t):
    rest = F.concat_ws("\t", F.concat(F.lit("n"), "id"), C("id").cast("string"), "strand", F.lit("x"), F.lit("0.5"))
    return classification.classify(t.b.select("chr", "start", "end", rest.alias("rest")))


@query("""WITH k AS (SELECT DISTINCT user_id AS barcode FROM events WHERE user_id % 3 <> 0) SELECT f.id AS id, f.barcode AS barcode, 'c' || (f.barcode % 4) AS cluster FROM fragments f JOIN k USING (barcode)""")
def fragment_clusters(t):
    f = t.fragments.withColumn("file", F.lit("f"))
    k = f.select("file", "barcode").distinct().filter("barcode % 3 <> 0").withColumn("cluster", F.concat(F.lit("c"), C("barcode") % 4))
    return scoring.barcode_clusters(f, k).select("id", "barcode", "cluster")


# aligned reads and variant descriptions


@query(f"""WITH track AS ({_track('SELECT chr, start + 1 AS pos, 1 AS d FROM iv_a UNION ALL SELECT chr, "end", -1 FROM iv_a')}), s AS (SELECT chr, size - 150 AS size FROM sizes)
SELECT 'core' AS kind, chr, start, least("end", size + 1) AS "end", count FROM track JOIN s USING (chr) WHERE start < least("end", size + 1)""")
def aligned_coverage(t):
    reads = t.a.select("chr", C("start").alias("pos"), "end", F.lit(0).alias("flag"))
    return alignments.tracks(reads, t.sizes.withColumn("size", C("size") - 150), ("core",))


@query("""SELECT chr, s AS start, s + 1 AS "end" FROM (SELECT chr, CASE WHEN strand = '-' THEN "end" - 5 ELSE start + 4 END AS s FROM iv_b)""")
def cut_positions(t):
    return alignments.cut_sites(t.b.select("chr", C("start").alias("pos"), "end", F.when(C("strand") == "-", 16).otherwise(0).alias("flag")))


@query("""SELECT id, 'NC_' || id AS accession, CASE k WHEN 3 THEN 'c' ELSE 'g' END AS kind, CASE k WHEN 0 THEN 'sub' WHEN 1 THEN 'del' WHEN 2 THEN 'ins' WHEN 3 THEN 'dup' ELSE 'unknown' END AS edit,
  CASE k WHEN 4 THEN NULL ELSE n END AS first, CASE k WHEN 4 THEN NULL WHEN 0 THEN n ELSE n + 1 END AS second, k = 1 AS ranged FROM (SELECT o_orderkey AS id, o_orderkey % 5 AS k, o_custkey + 1 AS n FROM orders)""")
def parsed_descriptions(t):
    k, n = C("o_orderkey") % 5, (C("o_custkey") + 1).cast("string")
    m = (C("o_custkey") + 2).cast("string")
    edit = (
        F.when(k == 0, F.concat(F.lit("g."), n, F.lit("A>T"))).when(k == 1, F.concat(F.lit("g.(?_"), n, F.lit(")_("), m, F.lit("_?)del"))).when(k == 2, F.concat(F.lit("g."), n, F.lit("_"), m, F.lit("insGG")))
        .when(k == 3, F.concat(F.lit("c.*"), n, F.lit("-7_*"), m, F.lit("dup"))).otherwise("g.?")
    )
    x = t.read("orders").select(C("o_orderkey").alias("id"), F.concat(F.lit("NC_"), "o_orderkey", F.lit(":"), edit).alias("s"))
    x = x.withColumn("h", nomenclature.parse("s"))
    return x.select("id", "h.accession", "h.kind", "h.edit", C("h.first.number").alias("first"), C("h.second.number").alias("second"), "h.ranged")
