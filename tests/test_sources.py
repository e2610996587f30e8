"""Contracts and CSV files."""

import pytest

from plumbline.sources import contract as C, csv_tables as T, experiments, harmonise, sinks
from plumbline.streaming import windows


def files(tmp_path, **texts):
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode() if isinstance(text, str) else text)
    return [str(tmp_path / f"{n}.csv") for n in texts]


def contract(tmp_path, **options):
    return C.Contract(**{"cluster": 1, "name": "x", "directory": str(tmp_path), "label": "attack", "order": ("time",), "excluded": ("attack", "time")} | options)


def test_training_table(spark, tmp_path):
    files(tmp_path, a="time,sensor,mode,attack\n2,1.0,A,normal\n1,,B,attack\n", b="time,sensor,mode,attack\n4,3.0, A ,0\n3,1e1,n/a,1\n")
    rows, numeric, text = T.training_table(spark, contract(tmp_path))
    assert (numeric, text) == (["sensor"], ["mode"])
    found = rows.orderBy(T.FILE, T.ROW).collect()
    assert [(r.file_ord, r.label, r.sensor) for r in found] == [(0, 0, 1.0), (0, 1, None), (1, 0, 3.0), (1, 1, 10.0)]
    only = contract(tmp_path, files=("a.csv",))
    assert C.training_files(only) == [str(tmp_path / "a.csv")]


def test_refusals(spark, tmp_path):
    paths = files(tmp_path, a="time,sensor,wrong\n1,2,0\n")
    with pytest.raises(C.ContractError, match="not among its columns .time, sensor, wrong."):
        T.inspect(spark, paths, contract(tmp_path))
    for text, message in (("time,sensor,attack\n1,2,normal\n2,3,suspicious\n", "suspicious"), ("time,sensor,attack\n1,2,0\n2,3,0\n", "of one class"), ("time,sensor,attack\n1,2,0\n2,3\n", "number of cells"), ("", "empty")):
        with pytest.raises(C.ContractError, match=message):
            T.inspect(spark, files(tmp_path, b=text), contract(tmp_path))
    with pytest.raises(C.ContractError, match="must be excluded"):
        contract(tmp_path, excluded=("time",))
    with pytest.raises(C.ContractError, match="sum to 1"):
        contract(tmp_path, ratios=(0.5, 0.5, 0.5))
    with pytest.raises(C.ContractError) as error:
        C.training_files(contract(tmp_path, mode="combined", file=str(tmp_path / "none.csv"), missing_code="COMBINED_MISSING"))
    assert error.value.code == "COMBINED_MISSING"


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_numbers_of_splits(spark, tmp_path, small_splits):
    """Files of many splits, next to small ones that share a task: numbers, the first ragged row of each, and its message."""
    good = ["a,b"] + [f"{i},x" for i in range(700)]
    bad = [*good[:311], "7", *good[311:500], "1,2,3", *good[500:]]
    paths = files(tmp_path, good="\n".join(good) + "\n", bad="\r\n".join(bad), one="a,b\n1,2", none="a,b\n")
    parts = T.parts_of(paths)
    lines = T.numbered_lines(spark, parts)
    assert lines.rdd.getNumPartitions() > 10
    found = lines.orderBy(T.FILE, T.ROW).collect()
    assert [(r[T.FILE], r[T.ROW], r["__line"], r.value) for r in found] == [(f, i, i + 2, v) for f, rows in enumerate((good, bad, ["a,b", "1,2"], ["a,b"])) for i, v in enumerate(rows[1:])]
    assert [(r[T.FILE], r.line, r.n_cells, r.n_columns) for r in T.first_ragged(lines).collect()] == [(1, 312, 1, 2)]
    assert sorted(r.line for r in T.ragged_rows(lines).collect()) == [312, 502]
    with pytest.raises(C.ContractError, match="bad.csv: row 312 has another number of cells .1. than the header .2."):
        T.scan(spark, paths)
    rows = T.scan(spark, paths, ragged="pad").where(f"{T.FILE} = 1").orderBy(T.ROW).collect()
    assert (rows[310].a, rows[310].b) == ("7", None) and (rows[500].a, rows[500].b) == ("1", "2") and len(rows) == 702


def test_quotes_and_empty_lines(spark, tmp_path):
    paths = files(tmp_path, q='a,b,c\n"x, ""y""",,\n1,"",3\n', e="a\n1\n\n2\n")
    rows = T.scan(spark, paths[:1]).orderBy(T.ROW).collect()
    assert [tuple(r[:3]) for r in rows] == [('x, "y"', None, None), ("1", "", "3")] or [tuple(r[:3]) for r in rows] == [('x, "y"', None, None), ("1", None, "3")]
    with pytest.raises(C.ContractError, match="row 3 has another number of cells .0."):
        T.scan(spark, paths[1:])
    assert [(r.a, r[T.ROW]) for r in T.scan(spark, paths[1:], ragged="pad").orderBy(T.ROW).collect()] == [("1", 0), ("2", 2)]


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    context, counts = spark.sparkContext, []
    for n in (2, 9):
        texts = {f"f{n}_{i}": f"time,s{i % 3},attack\n1,2,0\n2,3,1\n" for i in range(n)}
        context.setJobGroup(f"inspect-{n}", "")
        found = T.inspect(spark, files(tmp_path, **texts), contract(tmp_path), consistent=False)
        assert found["labels"] == {0: n, 1: n} and len(found["profile"]) == 3 * n
        counts.append(len(context.statusTracker().getJobIdsForGroup(f"inspect-{n}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1] > 0


def test_folders_of_parts(spark, tmp_path):
    """A folder is one file whose rows count on over its parts; parts must have one header."""
    folder = tmp_path / "parts"
    folder.mkdir()
    for i, text in enumerate(("a,b\n1,2\n3,4\n", "a,b\n5,6\n", "a,b\n")):
        (folder / f"part-{i}.csv").write_text(text)
    assert [(r[T.ROW], r.a) for r in T.scan(spark, [str(folder)]).orderBy(T.ROW).collect()] == [(0, "1"), (1, "3"), (2, "5")]
    (folder / "part-1.csv").write_text("a,b\n5\n")
    with pytest.raises(C.ContractError, match=r"parts \(part-1.csv\): row 2"):
        T.scan(spark, [str(folder)])
    (folder / "part-3.csv").write_text("b,a\n")
    with pytest.raises(C.ContractError, match="different headers"):
        T.scan(spark, [str(folder)])


def test_schemas_and_marks(spark, tmp_path):
    paths = files(tmp_path, a=b"\xef\xbb\xbfdate,temp,attack\n1,2,0\n", b="date,lat,attack\n1,2,1\n")
    found = T.inspect(spark, paths, contract(tmp_path, order=("date",), excluded=("attack", "date")), consistent=False)
    assert found["intersection"] == ["attack", "date"] and found["union"] == ["attack", "date", "lat", "temp"]
    assert not found["consistent"] and found["blockers"] and len(found["issues"]) == 1 and found["labels"] == {0: 1, 1: 1}


def test_harmonised(spark, tmp_path):
    parts = {"Fridge": "date,time,fridge_temperature,label,type\n25-Apr-19, 19:19:40 ,1.5,0,normal\n", "Garage_Door": "date,time,door_state,label,type\n25-Apr-19,19:20:00,open,1,ddos\n"}
    paths = files(tmp_path, **parts)
    tables = {n: T.scan(spark, [p]).drop(T.FILE, T.ROW) for n, p in zip(parts, paths)}
    whole = harmonise.harmonised(tables, shared=["date", "time"], last=["label", "type"])
    assert whole.columns == ["date", "time", "source", "fridge_temperature", "door_state", "label", "type"]
    assert [tuple(r) for r in whole.orderBy("time").collect()][0] == ("25-Apr-19", "19:19:40", "fridge", "1.5", "", "0", "normal")
    with pytest.raises(harmonise.SchemaError, match="x lacks time"):
        harmonise.union_columns({"x": ["date", "a", "label", "type"]}, shared=["date", "time"], last=["label", "type"])


def test_yaml_contract_and_root(tmp_path, monkeypatch):
    path = tmp_path / "c.yaml"
    path.write_text("cluster: 2\nname: n\ndirectory: data/raw/x\nlabel: y\nexcluded: [y]\nnote: 1\n")
    assert C.load_contract(str(path)).extra == {"note": 1}
    monkeypatch.setenv(C.ROOT_VARIABLE, "/mnt/data")
    assert C.resolve("data/raw/x") == "/mnt/data/x" and C.resolve("/abs") == "/abs"
    path.write_text("cluster: two\nname: n\ndirectory: d\nlabel: y\nexcluded: [y]\n")
    with pytest.raises(C.ContractError, match="cluster must be int"):
        C.load_contract(str(path))


def test_experiments(spark, tmp_path):
    header = "experiment_id,cluster_id,model_family,fl_method,hierarchy,aggregation\n"
    (path,) = files(tmp_path, m=header + "A_C1,1,cnn,FedAvg,flat,mean\nB_C1,1,cnn,FedAvg,two,mean\n")
    assert experiments.read_matrix(spark, path).count() == 2
    with pytest.raises(C.ContractError, match="repeated"):
        experiments.read_matrix(spark, files(tmp_path, m2=header + "A,1,c,f,h,a\nA,1,c,f,h,a\n")[0])
    assert experiments.select_experiments(["A_C1", "B_C1"], suite="A") == ["A_C1"]
    with pytest.raises(C.ContractError):
        experiments.select_experiments(["A_C1"], explicit=["Z"], everything=True)
    (metrics,) = files(tmp_path, r="round,f1,auroc\n1,0.5,metric_unavailable_single_class\n")
    row = experiments.read_one_row(spark, metrics, ["f1", "auroc"])
    assert (row.f1, row.auroc) == (0.5, None)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("A", 42, "train", 0, 0.5, 1)], "experiment_id string, seed int, split string, client int, p double, label int")
    sinks.write_predictions(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    with pytest.raises(sinks.EmptyResultError):
        sinks.write_csv(rows.limit(0), str(tmp_path / "c"))
    status = "experiment_id string, seed int, status string, detail string, at long"
    sinks.write_status(spark.createDataFrame([("A", 1, "FAILED", "x", 1), ("A", 1, "COMPLETE", "", 2)], status), str(tmp_path / "s"))
    assert sinks.read_status(spark, str(tmp_path / "s")).first().status == "COMPLETE"


def test_streamed_counts(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("cast(ts as timestamp) ts", "int(event_type = 'error') label")
    source.write.parquet(str(tmp_path / "in"))
    stream = windows.label_counts(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")), width="1 day")
    query = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n_rows) n, sum(positives) p FROM counted").first() == source.selectExpr("count(*) n", "sum(label) p").first()


def test_nested_registry(spark, tmp_path):
    texts = {
        "flat.yaml": "experiment_group: A\nclusters:\n  - {experiment_id: A_C1, cluster_config: c/one.yaml, n_subclusters: 0}\n  - {experiment_id: A_C2, cluster_config: c/two.yaml, fl_method: FedAvg}\n",
        "arms.yaml": "comparisons:\n  - control: {experiment_id: AB_C1, cluster_config: c/one.yaml, rate: 0.01}\n    treatment: {experiment_id: P_C1}\n  - control: {experiment_id: B_C1, cluster_config: c/one.yaml}\n",
        "none.yaml": "experiment_group: A\n", "again.yaml": "experiment_group: B\nclusters: [{experiment_id: A_C1, cluster_config: c/one.yaml}]\n", "bare.yaml": "experiment_group: B\nclusters: [{experiment_id: B_C2}]\n",
        "c/one.yaml": "cluster: {id: 1, dataset_name: x}\n", "c/two.yaml": "cluster: {id: 2, dataset_name: y}\n", "c/bad.yaml": "cluster: {id: 3}\n", "third.yaml": "experiment_group: C\nclusters: [{experiment_id: C_C3, cluster_config: c/bad.yaml}]\n",
    }
    (tmp_path / "c").mkdir()
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    read = lambda *names: experiments.nested_registry(spark, [str(tmp_path / n) for n in names], root=str(tmp_path))
    found = {r.experiment_id: r for r in read("flat.yaml", "arms.yaml").collect()}
    assert {k: (r.experiment_group, r.cluster_id, r.dataset_name) for k, r in found.items()} == {"A_C1": ("A", 1, "x"), "A_C2": ("A", 2, "y"), "AB_C1": ("ablation_fl_method", 1, "x")}
    assert found["A_C1"].entry["n_subclusters"] == "0" and found["AB_C1"].entry["rate"] == "0.01"
    for names, message in ((["none.yaml"], "without experiments"), (["flat.yaml", "again.yaml"], "A_C1"), (["bare.yaml"], "B_C2"), (["third.yaml"], "bad.yaml")):
        with pytest.raises(C.ContractError, match=message):
            read(*names)
