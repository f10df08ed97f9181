"""Command line: ``spark-submit -m sparkfold`` style use as ``python -m sparkfold COMMAND ...``.

analyze FILES [--json] [--full]   what each file is and which strategy suits it; --full adds the entropies of its blocks
compress FILES TO                 containers of all files of a folder, named by their paths in it
decompress FROM TO                the files of a folder of containers

The exit code is 1 if any file could not be compressed, read or verified; each is named.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfold.functions import content as C
from sparkfold.functions.lineage import cut
from sparkfold.operators import orchestrate
from sparkfold.sources import container, files

BLOCK = 64 << 10


def _complain(rows: DataFrame, why: str) -> int:
    """Names what failed; 1 if anything did."""
    failed = 0
    for r in rows.select("name", F.col(why).cast("string").alias("why")).toLocalIterator():
        print(f"{r['name']}: {r['why']}", file=sys.stderr)
        failed = 1
    return failed


def _analyze(spark: SparkSession, source: str, as_json: bool, full: bool) -> int:
    every = files.binary(spark, source)
    found = orchestrate.analyse(every)
    if full:
        found = found.withColumn("block_entropies", C.block_entropies(BLOCK)(F.col("content")))
    found = found.drop("content", "modified").orderBy("path")
    if as_json:
        for r in found.toJSON().toLocalIterator():
            print(r)
        return 0
    for r in found.withColumn("bar", C.entropy_bar(F.col("entropy"))).toLocalIterator():
        print(f"{r['path']}\n  {r['format_type']} ({r['mime_type']}), {r['size']} bytes\n  entropy {r['entropy']:.3f} {r['bar']} {r['label']}, about {r['est_ratio']:.2f}x\n  strategies: {', '.join(r['hints'])}")
        if r["image"] is not None:
            i = r["image"]
            print(f"  image {i['w']} x {i['h']}: {r['content_type']} ({r['content_confidence']:.2f}), {r['domain']}, {r['generation']}; {i['palette_size']} colours, edges {i['edge_density']:.3f}")
        for note in r["notes"]:
            print(f"  note: {note}")
        if full:
            print("  blocks: " + " ".join(f"{e:.2f}" for e in r["block_entropies"]))
    return 0


def main(args: list[str], spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkfold", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("source")
    a.add_argument("--json", action="store_true")
    a.add_argument("--full", action="store_true")
    for name in ("compress", "decompress"):
        c = sub.add_parser(name)
        c.add_argument("source")
        c.add_argument("target")
    o = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("sparkfold").getOrCreate()
    spark.dataSource.register(container.Container)
    if o.command == "analyze":
        return _analyze(spark, o.source, o.json, o.full)
    if o.command == "compress":
        done = cut(orchestrate.compress(files.binary(spark, o.source), o.source))
        done.where("strategy IS NOT NULL").select("name", "original_size", "strategy", "metadata", "payload").write.format("container").mode("append").save(o.target)
        return _complain(done.where("strategy IS NULL"), "errors")
    held = cut(spark.read.format("container").load(o.source))
    back = cut(orchestrate.decompress(held.where("error IS NULL")))
    files.write(back.where("verified"), o.target)
    return _complain(held.where("error IS NOT NULL"), "error") | _complain(back.where("NOT verified").withColumn("why", F.lit("not what was compressed")), "why")


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
