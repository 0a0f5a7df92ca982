"""spark-submit lociweave/cli.py -mem K -file PATH -out PREFIX: discover, and write all tables, for one K or several."""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("-mem", required=True, help="least match length K, several of them with commas between, or a file that lists them")
    parser.add_argument("-file", required=True, help="sequence files with gene metadata; each is a family")
    parser.add_argument("-out", required=True, help="prefix of the output folders")
    parser.add_argument("-mode", choices=("strict", "literal"), default="strict")
    parser.add_argument("-by_name", action="store_true", help="match genes and sequences by name, not by order")
    parser.add_argument("-offsets", action="store_true", help="write where each record starts, too")
    parser.add_argument("-texts", action="store_true", help="write the text that each family is searched as, too")
    parser.add_argument("-template", help="a page template; pages that read the tables are written from it, too")
    options = parser.parse_args(args)
    from pyspark.sql import SparkSession

    from lociweave.plans.discover import by_name, discover, shared_repeats
    from lociweave.sources import pages as G
    from lociweave.sources import writers as W
    from lociweave.sources.fasta import k_values, read_families, record_offsets

    spark = SparkSession.builder.appName("lociweave").getOrCreate()
    sequences, genes = read_families(spark, options.file)
    if options.by_name:
        genes = by_name(sequences, genes)
    ks = k_values(spark, options.mem)
    template = G.read_template(spark, options.template) if options.template else None
    repeats = shared_repeats(sequences, genes, ks) if len(ks) > 1 and options.mode == "strict" else None
    for k in ks:
        found = discover(sequences, genes, k, mode=options.mode, repeats=repeats)
        lengths, prefix = found["texts"].select("family_id", "len"), f"{options.out}_"
        W.write_words(found["mem"], f"{prefix}mems_{k}")
        W.write_lines(W.anchor_lines(found["mem"], lengths, serial=True), f"{prefix}MEM_1_{k}")
        W.write_lines(W.anchor_lines(found["mem"], lengths, serial=False), f"{prefix}MEM_2_{k}")
        W.write_lines(W.anchor_lines(found["chain"], lengths, serial=False, order_by="step"), f"{prefix}LPMEM_{k}")
        W.write_lines(W.cns_lines(found["cns"], genes), f"{prefix}CNS_{k}")
        W.write_tracks(W.tracks(found["cns"], genes), f"{prefix}tracks_{k}")
        G.write_pages(found["mem"], genes, f"{prefix}MEM_{k}_pages")
        G.write_pages(found["chain"], genes, f"{prefix}LPMEM_{k}_pages")
        if template:
            W.write_lines(G.template_lines(genes, template, f"MEM_2_{k}.csv"), f"{prefix}MEM_{k}_html")
            W.write_lines(G.template_lines(genes, template, f"LPMEM_{k}.csv"), f"{prefix}LPMEM_{k}_html")
    if options.texts:
        W.write_texts(found["texts"], f"{prefix}texts")
    if options.offsets:
        W.write_offsets(record_offsets(sequences), f"{prefix}offsets")


if __name__ == "__main__":
    main()
