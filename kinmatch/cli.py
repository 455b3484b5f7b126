"""Command line: python -m kinmatch.cli {eda,validate,predict,predict-only,package,synthesize}."""

from __future__ import annotations

import argparse
import importlib
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from .operators import report
from .operators.records import stack
from .plans import linkage
from .plans.config import RunConfig
from .sources import synthetic, tsv


def encoder(name: str | None) -> linkage.EmbedFn | None:
    """module:function, from texts to unit vectors; it is imported where it runs."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return lambda texts: getattr(importlib.import_module(module), function)(texts)


def _show(title: str, df: DataFrame) -> None:
    print(f"== {title}")
    df.show(50, truncate=70)


def eda(args: argparse.Namespace) -> None:
    spark = linkage.session()
    for name in ("train", "test"):
        tables = tsv.load_split(spark, args.data_dir, name)
        records = stack(tables.s1, tables.s2, tables.s3)
        _show(f"{name}: rows by source and country", report.country_counts(records))
        _show(f"{name}: empty fields", report.empty_rates(records))
        if tables.truth is None:
            continue
        _show("anchors without a match", report.singleton_rate(tables.truth))
        _show("matches per anchor", report.match_histogram(tables.truth))
        _show("claims beyond a target's first", report.multi_claimed(tables.truth))
        _show("matched share of targets", report.matched_share(tables.truth, records))
        _show("matches across countries", report.cross_country(tables.truth, records))
        _show("anchors matched in both targets", report.match_both(tables.truth))
        for source in ("S1", "S2", "S3"):
            _show(f"sample of {source}", report.sample(records, source))
        _show("one matched group", report.matched_group(tables.truth, records))


def validate(args: argparse.Namespace) -> None:
    tables = tsv.load_split(linkage.session(), args.data_dir, "train")
    config = RunConfig(one_to_one=not args.no_one_to_one, holdout_country=args.holdout_country, max_s1=args.max_s1)
    config = replace(config, block=replace(config.block, same_country=not args.no_same_country, max_bucket=args.max_bucket, max_cand=args.max_cand))
    done = linkage.validate(tables, config, args.val_frac, encoder(args.encoder))
    done.config.save(args.art_dir, args.tag)
    tsv.write_scored_pairs(done.scored, f"{args.art_dir}/val_scored_pairs.tsv.gz")
    print(done.config, done.importances)
    print(f"positive rate of labelled pairs: {done.positive_rate:.3%}")
    for title, df in (("recall", done.recall), ("macro F0.5", done.macro), ("by country", done.by_country), ("predicting nothing", done.baseline)):
        _show(title, df)


def _finish(tables, fitted: PipelineModel, config: RunConfig, args: argparse.Namespace) -> None:
    made = linkage.predict(tables, fitted, config, encoder(args.encoder))
    linkage.write_prediction(made, args.out_dir)
    _show("by country", made.summary)
    _show("checks", linkage.check_lists(made.matches, made.candidates, linkage.anchors_of(tables)))
    code = linkage.run_validator(args.validator, args.out_dir, f"{args.data_dir}/test")
    print(f"validator {args.validator}: " + ("not found" if code is None else f"exit code {code}"))


def predict(args: argparse.Namespace) -> None:
    spark = linkage.session()
    config = RunConfig.load(args.art_dir, args.config).with_max_cand(args.max_cand_override)
    fitted = linkage.fit_final(tsv.load_split(spark, args.data_dir, "train"), config, encoder(args.encoder), args.train_max_s1)
    fitted.write().overwrite().save(f"{args.art_dir}/final_model")
    _finish(tsv.load_split(spark, args.data_dir, "test"), fitted, config, args)


def predict_only(args: argparse.Namespace) -> None:
    spark = linkage.session()
    config = RunConfig.load(args.art_dir, args.config).with_max_cand(args.max_cand_override)
    fitted = PipelineModel.load(args.model or f"{args.art_dir}/final_model")
    _finish(tsv.load_split(spark, args.data_dir, "test"), fitted, config, args)


def synthesize(args: argparse.Namespace) -> None:
    spark = linkage.session()
    synthetic.write_split(synthetic.make_split(spark, ["US", "India"], args.n, 7), args.out, "train")
    test = synthetic.make_split(spark, ["US", "India", "France"], args.n // 2, 8)
    synthetic.write_split(replace(test, truth=None), args.out, "test")


def package(args: argparse.Namespace) -> None:
    for name in linkage.package(args.out_dir, f"{args.team}_submission.zip", args.code_dir, tuple(args.document)):
        print(name)


# The names and defaults of the options that existing runs use. --encoder, --validator and package's options are this library's.
def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinmatch")
    sub = top.add_subparsers(required=True)

    def command(name: str, run, *dirs: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for d, default in (("data_dir", "dataset"), ("art_dir", "artifacts"), ("out_dir", "output")):
            if d in dirs:
                p.add_argument(f"--{d}", default=default)
        return p

    command("eda", eda, "data_dir")
    p = command("validate", validate, "data_dir", "art_dir")
    p.add_argument("--val_frac", type=float, default=0.2)
    p.add_argument("--holdout_country")
    p.add_argument("--max_s1", type=int)
    p.add_argument("--max_bucket", type=int, default=1000)
    p.add_argument("--max_cand", type=int, default=50)
    p.add_argument("--no_same_country", action="store_true")
    p.add_argument("--no_one_to_one", action="store_true")
    p.add_argument("--tag", default="run")
    p.add_argument("--encoder", help="module:function from texts to unit vectors; turns neighbours on")
    for name, run in (("predict", predict), ("predict-only", predict_only)):
        p = command(name, run, "data_dir", "art_dir", "out_dir")
        p.add_argument("--config")
        p.add_argument("--encoder", help="module:function from texts to unit vectors; turns neighbours on")
        p.add_argument("--validator", default="utils/validate_submission.py")
        p.add_argument("--max_cand_override", type=int, default=3 if name == "predict-only" else None)
        p.add_argument(*(("--model",) if name == "predict-only" else ("--train_max_s1",)), **({} if name == "predict-only" else {"type": int}))
    p = command("package", package, "out_dir")
    p.add_argument("team")
    p.add_argument("--code_dir")
    p.add_argument("--document", action="append", default=[])
    p = command("synthesize", synthesize)
    p.add_argument("--out", default="synthetic/dataset")
    p.add_argument("--n", type=int, default=600)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(args)


if __name__ == "__main__":
    main()
