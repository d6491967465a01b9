"""Commands on files: python -m locusflow COMMAND ... (--help lists them).

Rows go to --output as one file, or else to the standard output; they are streamed
there, a partition at a time."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.operators import alignments, coverage, databases, overlaps, ranges, scoring, sequences, statistics
from locusflow.plans.scratch import scratch
from locusflow.sources import arrays, bam, files, indexed, readers, sinks

C = F.col


def _regions(spark: SparkSession, path: str) -> DataFrame:
    return readers.bed(spark, path).select("chr", "start", "end", "rest")


def _put(spark: SparkSession, lines: DataFrame, output: str | None) -> None:
    if output is None:
        for r in lines.toLocalIterator():
            print(r[0])
        return
    folder = scratch(spark, "lines")
    lines.write.option("compression", "gzip" if output.endswith(".gz") else "none").text(folder)
    files.combine(spark, folder, output)


def _table(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    df = df.orderBy(*order) if order else df
    return df.select(F.concat_ws("\t", *[F.coalesce(C(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]))


def _bed(df: DataFrame) -> DataFrame:
    return _table(df.select("chr", "start", "end"), ["chr", "start", "end"])


def _one(work):
    return lambda spark, o: _bed(work(_regions(spark, o.input), spark, o))


def _two(work):
    return lambda spark, o: _bed(work(_regions(spark, o.a), _regions(spark, o.b)))


def _paired(a: DataFrame, b: DataFrame) -> DataFrame:
    return ranges.pintersect(ranges.numbered(a), ranges.numbered(b))


#: verb: (its work, its options besides those of files)
RANGES = {
    "reduce": (_one(lambda x, s, o: ranges.reduce(x)), {}),
    "trim": (_one(lambda x, s, o: ranges.trim(x, readers.chrom_sizes(s, o.chrom_sizes))), {"--chrom-sizes": {"required": True}}),
    "promoters": (_one(lambda x, s, o: ranges.promoters(x, o.upstream, o.downstream)), {"--upstream": {"type": int, "default": 2000}, "--downstream": {"type": int, "default": 200}}),
    "shift": (_one(lambda x, s, o: ranges.shift(x, o.offset)), {"--offset": {"type": int, "required": True}}),
    "flank": (_one(lambda x, s, o: ranges.flank(x, o.width, o.start, o.both)), {"--width": {"type": int, "required": True}, "--start": {"action": "store_true"}, "--both": {"action": "store_true"}}),
    "resize": (_one(lambda x, s, o: ranges.resize(x, o.width, o.fix)), {"--width": {"type": int, "required": True}, "--fix": {"choices": ["start", "end", "center"], "default": "start"}}),
    "narrow": (_one(lambda x, s, o: ranges.narrow(x, o.start, o.end, o.width)), {"--start": {"type": int}, "--end": {"type": int}, "--width": {"type": int}}),
    "disjoin": (_one(lambda x, s, o: ranges.disjoin(x)), {}),
    "gaps": (_one(lambda x, s, o: ranges.gaps(x, readers.chrom_sizes(s, o.chrom_sizes))), {"--chrom-sizes": {"required": True}}),
    "setdiff": (_two(ranges.setdiff), None),
    "intersect": (_two(ranges.intersect), None),
    "union": (_two(ranges.union), None),
    "concat": (_two(lambda a, b: a.unionByName(b)), None),
    "pintersect": (_two(_paired), None),
    "jaccard": (lambda s, o: _table(statistics.similarity(_regions(s, o.a), _regions(s, o.b)).select("jaccard")), None),
}


def _overlaps(spark: SparkSession, o) -> DataFrame:
    return _bed(overlaps.subset_by_overlaps(_regions(spark, o.universe), _regions(spark, o.query)))


def _consensus(spark: SparkSession, o) -> DataFrame:
    return _table(statistics.consensus(readers.region_sets(spark, o.beds)).filter(C("count") >= o.min_count), ["chr", "start", "end"])


def _igd_create(spark: SparkSession, o) -> None:
    sets = readers.region_sets(spark, o.filelist)
    databases.RegionDB.from_sets(sets, sets.select("set_id", F.element_at(F.split("file", "/"), -1).alias("filename")).distinct()).save(o.output)


def _igd_search(spark: SparkSession, o) -> DataFrame:
    queries = _regions(spark, o.query).withColumn("id", F.monotonically_increasing_id())
    return _table(databases.RegionDB.load(spark, o.database).search(queries), ["set_id"])


def _uniwig(spark: SparkSession, o) -> None:
    sizes = readers.chrom_sizes(spark, o.chromref) if o.chromref else bam.sizes(spark, o.file).groupBy("chr").agg(F.max("size").alias("size"))
    kinds = ("start", "end", "core") if o.counttype == "all" else (o.counttype,)
    kind = readers.kind_of(o.file)[0]
    if kind in ("bam", "sam"):
        reads = bam.bam(spark, o.file) if kind == "bam" else readers.sam(spark, o.file)
        tracks = alignments.tracks(reads, sizes, kinds, o.smoothsize)
    else:
        rows = readers.scored_bed(spark, o.file, "narrowpeak" if kind == "narrowpeak" else "bed").join(sizes.select("chr"), "chr", "left_semi")
        score = C("score") if o.score else None
        tracks = None
        for k in kinds:
            t = coverage.runs(coverage.core_events(rows, score) if k == "core" else coverage.point_events(rows, k, o.smoothsize, score)).withColumn("kind", F.lit(k))
            tracks = t if tracks is None else tracks.unionByName(t)
    if o.outputtype == "npy":
        arrays.npy(tracks, o.fileheader, sizes, o.stepsize)
        return
    for k in kinds:
        track, folder = tracks.filter(C("kind") == k).drop("kind"), scratch(spark, "track")
        if o.outputtype == "bw":
            indexed.bigwig(track, sizes, f"{o.fileheader}_{k}.bw")
            continue
        if o.outputtype == "bedgraph":
            sinks.bedgraph(track, folder)
        else:
            steps = track.select("chr", F.ceil(C("start") / o.stepsize).alias("start"), F.ceil(C("end") / o.stepsize).alias("end"), "count").filter("end > start")
            sinks.wig(steps, folder, step=o.stepsize)
        files.combine(spark, folder, f"{o.fileheader}_{k}.{'bedGraph' if o.outputtype == 'bedgraph' else 'wig'}")


def _bamqc(spark: SparkSession, o) -> DataFrame:
    reads = bam.bam(spark, o.input)
    x = alignments.rates(alignments.library_complexity(reads), reads)
    return x.select(F.to_json(F.struct(*x.columns)))


def _split(spark: SparkSession, o) -> None:
    f = readers.fragments(spark, o.fragments).withColumn("file", readers.file_stem(C("file")))
    key = F.split("key", "\\+")  # file+barcode
    known = readers.barcode_map(spark, o.mapping).select(F.get(key, F.lit(0)).alias("file"), F.get(key, F.lit(1)).alias("barcode"), "cluster")
    sinks.pseudobulk(scoring.barcode_clusters(f, known), o.output)


def _scoring(spark: SparkSession, o) -> None:
    f = readers.fragments(spark, o.fragments)
    row = "barcode" if o.barcode else "file"
    peaks = _regions(spark, o.consensus).select("chr", "start", "end", F.concat("chr", F.lit(":"), "start", F.lit("-"), "end").alias("id")).distinct()
    x = scoring.peak_counts(f.withColumn("barcode", C(row)), peaks, o.mode)
    sinks.matrix_market(x, o.output) if o.barcode else sinks.dense_matrix(x, o.output)


def _digests(spark: SparkSession, o) -> DataFrame:
    records = readers.fasta(spark, o.fasta)
    named = records.select(readers.file_stem(C("file")).alias("collection"), F.struct("file", "block", "line").alias("ord"), "name", "seq")
    x = sequences.level1(sequences.level2(named))
    return x.orderBy("collection").select(F.to_json(F.struct(*x.columns)))


def _distributions(spark: SparkSession, o) -> DataFrame:
    x = _regions(spark, o.bed)
    out = {
        "number_of_regions": x.count(),
        "chromosome_stats": [r.asDict() for r in statistics.chromosome_statistics(x).orderBy("chr").collect()],  # a row a chromosome
        "region_distribution": [r.asDict() for r in statistics.distribution(x, o.bins).orderBy("chr", "start").collect()],  # a row a bin
    }
    return spark.createDataFrame([(json.dumps(out),)], "value string")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="locusflow", description="Interval commands on Spark.")
    commands = p.add_subparsers(dest="command", required=True)

    def add(to, name, work, options, output=True):
        c = to.add_parser(name)
        for n, k in options.items():
            c.add_argument(n, **k)
        if output:
            c.add_argument("--output")
        c.set_defaults(work=work)

    need, whole = {"required": True}, {"type": int}
    verbs = commands.add_parser("ranges").add_subparsers(dest="verb", required=True)
    for name, (work, options) in RANGES.items():
        add(verbs, name, work, {"-a": need, "-b": need} if options is None else {"--input": need, **options})
    igd = commands.add_parser("igd").add_subparsers(dest="verb", required=True)
    add(igd, "create", _igd_create, {"--filelist": need, "--output": need}, False)
    add(igd, "search", _igd_search, {"--database": need, "--query": need})
    add(commands, "overlaps", _overlaps, {"--query": need, "--universe": need})
    add(commands, "consensus", _consensus, {"--beds": {"nargs": "+", **need}, "--min-count": {**whole, "default": 1}})
    add(commands, "uniwig", _uniwig, {
        "--file": need, "--chromref": {}, "--smoothsize": {**whole, "default": 0}, "--stepsize": {**whole, "default": 1}, "--fileheader": need, "--score": {"action": "store_true"},
        "--outputtype": {"choices": ["wig", "bedgraph", "npy", "bw"], "default": "wig"}, "--counttype": {"choices": ["start", "end", "core", "all"], "default": "all"},
    }, False)
    add(commands, "bamqc", _bamqc, {"--input": need})
    add(commands, "pb", _split, {"fragments": {}, "mapping": {}, "--output": need}, False)
    add(commands, "fscoring", _scoring, {"fragments": {}, "consensus": {}, "--mode": {"choices": ["atac", "chip"], "default": "atac"}, "--barcode": {"action": "store_true"}, "--output": need}, False)
    add(commands, "refget", _digests, {"--fasta": need})
    add(commands, "genomicdist", _distributions, {"--bed": need, "--bins": {**whole, "default": 250}})
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("locusflow").getOrCreate()
    lines = o.work(spark, o)
    if lines is not None:
        _put(spark, lines, getattr(o, "output", None))


if __name__ == "__main__":
    main(sys.argv[1:])
