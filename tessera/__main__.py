"""python -m tessera COMMAND: formulas and panels from the command line. Results are written as Parquet or shown."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("parse", "check a formula and show its canonical form"), ("evaluate", "IC statistics of formulas"), ("signals", "values of formulas"), ("combine", "equal combination of formulas"), ("backtest", "quintile backtest of a formula"), ("sensitivity", "perturbed variants of a formula"), ("screen", "staged admission of formulas"), ("validate-data", "counts of faults in a panel"), ("resample-data", "bars of a longer interval")):
        c = sub.add_parser(name, help=text)
        if name != "parse":
            c.add_argument("panel", help="CSV or Parquet panel")
            c.add_argument("--out", help="where to write; the result is shown otherwise")
        if name not in ("validate-data", "resample-data"):
            c.add_argument("--formula", action="append", required=True, help="name=FORMULA or FORMULA; may be repeated")
            c.add_argument("--mode", choices=("tree", "kernel"), default="tree")
        if name == "resample-data":
            c.add_argument("--rule", default="1 day")
        if name == "backtest":
            c.add_argument("--cost-bps", type=float, default=4.0)
    return p


def _formulas(given: list[str]) -> dict[str, str]:
    return {(f.split("=", 1)[0] if "=" in f else f"f{i}"): f.split("=", 1)[-1] for i, f in enumerate(given, 1)}


def run(args: argparse.Namespace, spark: SparkSession) -> DataFrame:
    from pyspark.sql import functions as F

    from tessera.operators import library, metrics, portfolio, preparing
    from tessera.plans.compiler import evaluate
    from tessera.sources.panels import dense, load, with_vwap_returns

    raw = load(spark, args.panel)
    if args.command == "validate-data":
        return preparing.validation_report(raw)
    if args.command == "resample-data":
        return preparing.resample(raw, args.rule)
    panel = dense(preparing.with_targets(with_vwap_returns(raw))).withColumnRenamed("target_paper", "target")
    formulas = _formulas(args.formula)
    if args.command == "sensitivity":
        return portfolio.sensitivity(panel, next(iter(formulas.values())))
    wide = evaluate(panel, formulas, args.mode)
    names = list(formulas)
    if args.command == "signals":
        return wide.select("asset_id", "datetime", *names)
    if args.command == "combine":
        return library.combine_equal(library.long_form(wide, names))
    if args.command == "backtest":
        return metrics.backtest(wide, names[0], cost_bps=args.cost_bps)
    if args.command == "screen":
        chosen, why = library.screen(wide, names)
        return spark.createDataFrame([(f, "admitted") for f in chosen] + sorted(why.items()), "factor string, outcome string")
    values = library.long_form(wide, names).join(wide.select("asset_id", "t_idx", "target"), ["asset_id", "t_idx"])
    return metrics.ic_stats(metrics.ic_series(values, "v", "target", keys=("factor",)), "factor").orderBy(F.desc("ic_paper"))


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    if args.command == "parse":
        from tessera.plans.formula import canonical, digest, family, parse

        for name, f in _formulas(args.formula).items():
            tree = parse(f)
            print(json.dumps({"name": name, "formula": str(tree), "canonical": str(canonical(tree)), "digest": digest(tree), "family": family(tree)}))
        return
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = run(args, spark)
    if args.out:
        out.write.mode("overwrite").parquet(args.out)
    else:
        out.show(50, truncate=False)


if __name__ == "__main__":
    main()
