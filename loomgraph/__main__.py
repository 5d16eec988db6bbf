"""``python -m loomgraph stats|flp|leiden|hybrid FILE``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from loomgraph.plans import api


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    parser.add_argument("-d", "--debug", action="store_true")
    commands = parser.add_subparsers(dest="command")
    for name in ("stats", "flp", "leiden", "hybrid"):
        one = commands.add_parser(name)
        one.add_argument("file")
        if name != "stats":
            one.add_argument("--output", default="filtered_edge_list.parquet" if name == "hybrid" else "node_partitions.parquet")
            one.add_argument("--seed", type=int, default=1)
        if name in ("flp", "hybrid"):
            one.add_argument("--epochs", type=int, default=1)
        if name in ("leiden", "hybrid"):
            one.add_argument("--resolution", type=float, default=1.0)
            one.add_argument("--randomness", type=float, default=1.0)
    asked = parser.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if asked.debug else logging.INFO)
    if asked.command is None:
        return
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    if asked.command == "stats":
        print("nodes {}, edge weight {}, components {}, fraction in largest {}".format(*api.find_graph_statistics(spark, asked.file)))
    elif asked.command == "flp":
        print(api.run_label_propagation(spark, asked.file, asked.epochs, asked.output, asked.seed), "partitions")
    elif asked.command == "leiden":
        print("{} partitions, quality {}".format(*api.run_leiden(spark, asked.file, asked.resolution, output=asked.output, randomness=asked.randomness, seed=asked.seed)))
    else:
        print(*api.run_hybrid_community_detection(spark, asked.file, asked.resolution, True, asked.output, asked.epochs, asked.randomness, asked.seed), sep="\n")


if __name__ == "__main__":
    main()
