import gzip
import zipfile
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml import PipelineModel

from kinmatch import cli
from kinmatch.operators import blocking
from kinmatch.operators.model import GbtParams
from kinmatch.operators.records import normalise, stack
from kinmatch.plans import linkage
from kinmatch.plans.config import RunConfig
from kinmatch.sources import synthetic, tsv
from kinmatch.streaming.incremental import link_stream


def hashed_grams(texts):
    """A stand-in for an encoder: unit vectors of character pairs."""
    out = np.zeros((len(texts), 64))
    for i, t in enumerate(texts):
        for a, b in zip(t.lower(), t.lower()[1:]):
            out[i, (ord(a) * 31 + ord(b)) % 64] += 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("data"))
    synthetic.write_split(synthetic.make_split(spark, ["US", "India"], 60, 7), at, "train")
    synthetic.write_split(replace(synthetic.make_split(spark, ["US", "France"], 20, 8), truth=None), at, "test")
    return at


def test_tsv_keeps_odd_fields(spark, tmp_path):
    (tmp_path / "x.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t "Quote \tNA\tnull\n\nS1-2\ta\\b\n', encoding="utf-8")
    rows = [tuple(r) for r in tsv.read_tsv(spark, str(tmp_path / "x.tsv")).collect()]
    assert rows == [("S1-1", '"Quote', "NA", "null"), ("S1-2", "a\\b", "", "")]


def test_run(spark, data, tmp_path):
    tables = tsv.load_split(spark, data, "train")
    config = RunConfig(gbt=GbtParams(max_iter=8, min_instances=5), block=blocking.BlockingConfig(max_cand=5))
    done = linkage.validate(tables, config, val_frac=0.4, embed_fn=hashed_grams)
    assert done.macro.first()["macro_f05"] > 0.8 and 0 < done.positive_rate < 1
    recall = {r["scope"]: r["recall"] for r in done.recall.collect()}
    assert recall["all"] > 0.9
    done.config.save(str(tmp_path), "t")
    assert RunConfig.load(str(tmp_path)) == done.config and done.config.with_max_cand(3).block.max_cand == 3
    done.model.write().overwrite().save(str(tmp_path / "m"))
    test = tsv.load_split(spark, data, "test")
    assert test.truth is None
    made = linkage.predict(test, PipelineModel.load(str(tmp_path / "m")), done.config)
    assert {r["check"]: r["failures"] for r in linkage.check_lists(made.matches, made.candidates, linkage.anchors_of(test)).collect()} == {
        "matches_per_anchor": 0, "candidates_per_anchor": 0, "matches_are_candidates": 0,
    }
    linkage.write_prediction(made, str(tmp_path / "out"))
    lines = (tmp_path / "out/matching_results.tsv").read_text().splitlines()
    ids = [r[0] for r in test.s1.orderBy("ordinal").select("entity_id").collect()]
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and [x.split("\t")[0] for x in lines[1:]] == ids


def test_one_file_in_the_order_of_parts(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id AS a", "concat('x', id) AS b").repartitionByRange(7, "a").sortWithinPartitions("a")
    want = ["a\tb", *[f"{i}\tx{i}" for i in range(1000)]]
    tsv.write_tsv(rows, str(tmp_path / "one.tsv"), single_file=True)
    tsv.write_tsv(rows, str(tmp_path / "one.tsv.gz"), gzip=True, single_file=True)
    tsv.write_tsv(rows.where("a < 0"), str(tmp_path / "none.tsv"), single_file=True)
    assert (tmp_path / "one.tsv").read_text().splitlines() == want
    assert gzip.decompress((tmp_path / "one.tsv.gz").read_bytes()).decode().splitlines() == want
    assert (tmp_path / "none.tsv").read_text() == "a\tb\n"
    assert not [p for p in tmp_path.iterdir() if "parts" in p.name]


def test_validator_and_package(tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    for name in (linkage.MATCHES, linkage.CANDIDATES):
        (out / name).write_text("h\n")
    assert linkage.run_validator(str(tmp_path / "none.py"), str(out), "t") is None
    script = tmp_path / "v.py"
    script.write_text("import sys, pathlib\nsys.exit(0 if pathlib.Path(sys.argv[2]).read_text() == 'h\\n' and sys.argv[5:] == ['--test-dir', 't'] else 3)")
    assert linkage.run_validator(str(script), str(out), "t") == 0
    code = tmp_path / "code"
    (code / "tests").mkdir(parents=True)
    (code / "a.py").write_text("1")
    (code / "tests/b.py").write_text("2")
    names = linkage.package(str(out), str(tmp_path / "t.zip"), str(code), (str(script),))
    assert names == ["output/matching_results.tsv", "output/candidate_pairs.tsv", "code/code/a.py", "v.py"]
    assert zipfile.ZipFile(tmp_path / "t.zip").namelist() == names


def test_encoder_by_name():
    made = cli.encoder("tests.test_plans:hashed_grams")(["acme"])
    assert made.shape == (1, 64) and cli.encoder(None) is None
    assert cli.parser().parse_args(["validate", "--encoder", "m:f"]).encoder == "m:f"


def test_command_line():
    args = cli.parser().parse_args(["predict-only", "--data_dir", "d"])
    assert args.max_cand_override == 3 and args.run is cli.predict_only
    assert cli.parser().parse_args(["predict"]).max_cand_override is None
    assert cli.parser().parse_args(["validate", "--no_one_to_one", "--max_s1", "5"]).max_s1 == 5


def test_stream(spark, data, tmp_path):
    t = tsv.load_split(spark, data, "train")
    rows = stack(t.s1, t.s2, t.s3)
    rows.where("source = 'S1'").write.parquet(str(tmp_path / "in"))
    targets = blocking.blocking_keys(normalise(rows.where("source <> 'S1'")))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    link_stream(stream, targets, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r["a_id"], r["b_id"], r["score"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["a_id"], r["b_id"], r["score"]) for r in blocking.candidates(normalise(rows)).collect()}
    assert got == want
