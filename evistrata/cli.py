"""``python -m evistrata.cli COMMAND``: the pipeline's stages over tables in folders.

ingest     elements of pages or an element table -> sections, section texts, chunks
curate     reported facts and a concept map -> metrics
build      extractions, dictionary, chunks -> resolved relations, edges, mentions, resolution report
temporal   risks with vectors -> lineages and states
query      a registered query over a folder of tables
eval       runs and a benchmark -> scores, summary, failures
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from evistrata.operators import evaluation, facts, mentions, resolution, sections, temporal, upserts
from evistrata.plans import registry
from evistrata.sources import files


def ingest(spark: SparkSession, args) -> None:
    if args.manifest:
        pages = files.read_pages(spark, files.read_manifest(spark, args.manifest), args.source)
        elements = sections.html_elements(pages).join(pages.select("accession_no", "form"), "accession_no")
    else:
        elements = files.read_parquet(spark, args.source)
    rows = sections.segmented(elements)
    rows = rows.where(sections.kept_section(F.col("form"), F.col("section_id"))) if args.kept else rows
    files.write_parquet(rows, f"{args.out}/sections")
    rows = files.read_parquet(spark, f"{args.out}/sections")
    files.write_parquet(sections.section_texts(rows), f"{args.out}/section_texts")
    files.write_parquet(sections.chunks(rows), f"{args.out}/chunks")


def curate(spark: SparkSession, args) -> None:
    found = facts.curated_metrics(files.read_parquet(spark, args.source), files.read_parquet(spark, args.concepts))
    files.write_parquet(found, f"{args.out}/metrics")


def build(spark: SparkSession, args) -> None:
    entities, chunks = files.read_parquet(spark, args.entities), files.read_parquet(spark, args.chunks)
    resolved = resolution.resolved_relations(files.read_parquet(spark, args.source), entities)
    files.write_parquet(resolved, f"{args.out}/relations")
    resolved = files.read_parquet(spark, f"{args.out}/relations")
    files.write_parquet(resolution.resolution_report(resolved), f"{args.out}/resolution_report")
    days = chunks.groupBy("chunk_id").agg(F.min(F.to_date("filing_date")).alias("date"))
    seen = resolved.where("kept").join(days, "chunk_id").select("src", F.upper("relation").alias("rel"), "dst", "date", "chunk_id", F.col("evidence_quote").alias("quote"))
    files.write_parquet(upserts.accumulate_edges(seen), f"{args.out}/edges")
    files.write_parquet(mentions.mentioned(chunks, entities), f"{args.out}/mentions")


def temporal_(spark: SparkSession, args) -> None:
    risks = files.read_parquet(spark, args.source).withColumn("filing_date", F.to_date("filing_date"))
    found = temporal.lineages(risks, threshold=args.threshold)
    states = temporal.states(found.join(risks.drop("cik", "filing_date", "embedding"), "risk_id"))
    files.write_parquet(states, f"{args.out}/states")
    files.write_json_report(temporal.company_statistics(files.read_parquet(spark, f"{args.out}/states")), f"{args.out}/statistics")


def query(spark: SparkSession, args) -> None:
    if args.name not in registry.queries():
        raise SystemExit(f"no query {args.name!r}; there are: {', '.join(sorted(registry.queries()))}")
    found = registry.queries()[args.name](spark, args.source)
    if args.out:
        files.write_parquet(found, args.out)
    else:
        found.show(args.rows, truncate=120)


def eval_(spark: SparkSession, args) -> None:
    runs, benchmark = files.read_parquet(spark, args.source), files.read_parquet(spark, args.benchmark)
    files.write_parquet(evaluation.scored(runs, benchmark), f"{args.out}/scores")
    scores = files.read_parquet(spark, f"{args.out}/scores")
    files.write_json_report(evaluation.summary(scores), f"{args.out}/summary")
    failed = evaluation.failures(scores, runs)
    files.write_parquet(failed, f"{args.out}/failures")
    files.write_json_report(evaluation.failure_counts(failed), f"{args.out}/failure_counts")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="evistrata", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, /, **more: dict) -> None:
        sub = commands.add_parser(name)
        sub.add_argument("source", help="input table or folder")
        for flag, options in more.items():
            sub.add_argument(f"--{flag}", **options)
        sub.set_defaults(run=run)

    out = {"out": {"required": True}}
    command("ingest", ingest, manifest={}, kept={"action": "store_true"}, **out)
    command("curate", curate, concepts={"required": True}, **out)
    command("build", build, entities={"required": True}, chunks={"required": True}, **out)
    command("temporal", temporal_, threshold={"type": float, "default": temporal.SAME_RISK}, **out)
    command("query", query, name={"required": True}, rows={"type": int, "default": 20}, out={})
    command("eval", eval_, benchmark={"required": True}, **out)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    args.run(spark, args)


if __name__ == "__main__":
    main()
