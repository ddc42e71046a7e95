import datetime as dt

import pytest

from claritas.functions.hooks import encode, generate
from claritas.operators import checks, pairing
from claritas.sources import corpora, logs, sheets
from claritas.session import scratch_path, scratch_root
from claritas.streaming import boards


def test_json_and_csv_corpora(spark, tmp_path):
    (tmp_path / "train.json").write_text('{"id": 1, "original": "a", "falc": "b"}\n', encoding="utf-8")
    df = corpora.load_json_corpus(spark, {"train": str(tmp_path / "train.json")}, drop=("id",))
    assert [tuple(r) for r in df.select("split", "src", "dst").collect()] == [("train", "a", "b")]
    csv = 'original,simple,simple1\n"x -LRB- y\nnew ""line""",plain,other\n'
    (tmp_path / "val.csv").write_text(csv, encoding="utf-8")
    row = corpora.load_csv_corpus(spark, {"validation": str(tmp_path / "val.csv")}).first()
    assert (row.src, row.dst, row.split) == ('x  y\nnew "line"', "plain", "validation")


def test_location_is_required(spark):
    with pytest.raises(ValueError):
        corpora.load_json_corpus(spark, {"train": ""})
    with pytest.raises(KeyError):
        corpora.load_tasks(spark, "", ["nowhere"])


def test_cached_builds_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([("t", "train", "a")], "task string, split string, src string")

    for _ in range(3):
        assert corpora.cached(spark, str(tmp_path / "snap"), build).count() == 1
    assert len(built) == 1
    corpora.cached(spark, str(tmp_path / "snap"), build, use_cache=False)
    assert len(built) == 2
    corpora.cached(spark, str(tmp_path / "snap"), build, rows=2)
    assert len(built) == 3
    (tmp_path / "broken").mkdir()  # what a failed write leaves
    assert corpora.cached(spark, str(tmp_path / "broken"), build).count() == 1 and len(built) == 4


def test_malformed_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1}\n{"k": \n{"k": 3}\nnot json\n')
    good, bad = corpora.read_json_lines(spark, str(tmp_path), "k int")
    assert sorted(r.k for r in good.collect()) == [1, 3] and bad.count() == 2


def test_first_two_columns_and_line_count(spark, tmp_path):
    (tmp_path / "test.csv").write_text("original,simple,more\na,b,c\n")
    assert [tuple(r) for r in corpora.first_two_columns(spark, str(tmp_path / "test.csv")).collect()] == [("a", "b")]
    (tmp_path / "train.csv").write_text("1\n2\n3\n")
    assert corpora.count_lines(spark, str(tmp_path)).first().n_lines == 2


def test_sheets_with_index_columns_and_newlines(spark, tmp_path):
    (tmp_path / "eval.sheet.Ann.csv").write_text('sample_id,annotator_id,CI3,CI4\n1,ann,Oui,"Non\nApplicable"\n')
    (tmp_path / "eval.sheet.BOB.csv").write_text(",Unnamed: 0,sample_id,annotator_id,CI3\n0,0,2,bob,Non\n")
    df = sheets.read_all_sheets(spark, sorted(str(p) for p in tmp_path.iterdir()))
    assert set(df.columns) == {"sample_id", "annotator_id", "CI3", "CI4", "file_annotator"}
    got = {r.file_annotator: (r.sample_id, r.CI3, r.CI4) for r in df.collect()}
    assert got == {"ann": ("1", "Oui", "Non\nApplicable"), "bob": ("2", "Non", None)}


def test_flagged_sheet_rows_are_left_out(spark):
    rows = [(1, "a", "CI3", "Oui", "FALSE"), (1, "a", "CI4", "Non", "TRUE")]
    df = spark.createDataFrame(rows, "sample_id int, annotator_id string, criterion string, answer string, skip string")
    row = sheets.sheet_records(df, ["CI3", "CI4"]).first()
    assert (row.CI3, row.CI4) == ("Oui", None)


def test_csv_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "y"\nz'), ("b", "é")], "annotator string, text string")
    sheets.write_by(df, str(tmp_path / "out"), "annotator")
    back = sheets.read_keyed(spark, str(tmp_path / "out"), "text string, annotator string")
    assert sorted((r.annotator, r.text) for r in back.collect()) == [("a", 'x "y"\nz'), ("b", "é")]


def test_progress_logs(spark, tmp_path):
    for trial, rows in {"t1": "1,0.5\n2,0.7\n", "t2": "1,0.1\n"}.items():
        (tmp_path / trial).mkdir()
        (tmp_path / trial / "progress.csv").write_text("iteration,score\n" + rows)
    log = logs.read_progress(spark, str(tmp_path / "*" / "progress.csv"), "iteration long, score double")
    assert log.count() == 3
    assert {r.trial_id: r.score for r in logs.last_iterations(log).collect()} == {"t1": 0.7, "t2": 0.1}


def test_unaligned_rows_fail(spark):
    def side(name, keys):
        return spark.createDataFrame([(k, name) for k in keys], f"pos int, {name} string")

    good = pairing.align(side("src", [1, 2]), side("ref", [1, 2]), side("pred", [2, 1]), ["pos"])
    assert good.count() == 2
    with pytest.raises(Exception, match="unaligned row"):
        pairing.align(side("src", [1, 2]), side("ref", [1, 2]), side("pred", [1]), ["pos"]).collect()


def test_pairing_does_not_need_gapless_turns(spark):
    rows = [(1, 0, "system", "s"), (1, 3, "user", "q"), (1, 8, "assistant", "a"), (1, 9, "user", "open"), (2, 0, "user", "u"), (2, 1, "user", "v")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [(r.src, r.ref) for r in pairing.pair_turns(df).collect()] == [("q", "a")]


def test_checks(spark):
    df = spark.createDataFrame([("a", "train")], "task string, split string")
    expected = spark.createDataFrame([("a", "train"), ("a", "test")], "task string, split string")
    assert [tuple(r) for r in checks.empty_splits(df, expected).collect()] == [("a", "test")]
    row = checks.row_counts(df, expected).first()
    assert (row.n_left, row.n_right, row.equal) == (1, 2, False)
    with pytest.raises(ValueError):
        checks.require_columns(df, ["src"])


def test_hooks(spark):
    df = spark.createDataFrame([(1, "s", "u")], "k long, system_prompt string, user_prompt string")
    assert generate(df, lambda: lambda s, u: s + u, ["k"]).first().output == "su"
    vectors = encode(df, lambda: lambda texts: [[float(len(t))] for t in texts], "user_prompt", ["k"])
    assert vectors.first().embedding == [1.0]


def test_scratch_folder_comes_from_the_session(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


# --- streams -------------------------------------------------------------------------------------


def _log(spark, rows):
    return spark.createDataFrame(rows, "run int, metric string, ts timestamp_ntz, step long, value double")


def _rows(day, start, n, value=1.0):
    return [(i % 2, "m", dt.datetime(2024, 1, day, 0, i), start + i, value + i % 7) for i in range(n)]


def _stream(spark, path, batches):
    for i, rows in enumerate(batches):
        _log(spark, rows).coalesce(1).write.mode("append").parquet(path)
    schema = _log(spark, []).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_equals_batch(spark, tmp_path):
    batches = [_rows(1, 0, 20), _rows(1, 20, 20, 3.0), _rows(2, 40, 20)]
    stream = _stream(spark, str(tmp_path / "log"), batches)
    batch = _log(spark, [r for b in batches for r in b])
    for board, keys in ((boards.metric_board, ["run", "metric"]), (boards.best_so_far, ["run", "metric"])):
        got = boards.run_to_table(board(stream), keys)
        want = board(batch)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_late_events_are_dropped(spark, tmp_path):
    stream = _stream(spark, str(tmp_path / "log"), [_rows(1, 0, 4), _rows(9, 10, 4), _rows(9, 20, 4), _rows(1, 30, 4, 90.0)])
    board = boards.best_so_far(stream, delay="1 hour", period="1 day")
    got = boards.run_to_table(board, ["period", "run", "metric"]).where("day(period) = 1").collect()
    assert got and max(r.value for r in got) < 90.0


@pytest.mark.parametrize("mode", [None, "max", "min"])
def test_board_with_time_to_live_equals_batch(spark, tmp_path, mode):
    batches = [_rows(1, 0, 20), _rows(1, 20, 20, 3.0), _rows(2, 40, 20)]
    stream = _stream(spark, str(tmp_path / "log"), batches)
    batch = _log(spark, [r for b in batches for r in b])
    got = boards.run_to_table(boards.ended_runs_leave(stream, "30 days", mode=mode), ["run", "metric"])
    want = boards.ended_runs_leave(batch, "30 days", mode=mode)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_an_ended_run_leaves_the_state(spark, tmp_path):
    def of(run, day, value):
        return [(run, "m", dt.datetime(2024, 1, day, 0, i), i, value + i) for i in range(4)]

    # run 7 ends on day 1; others go on for weeks; a late event of run 7 must not revive it
    batches = [of(7, 1, 1.0) + of(0, 1, 1.0), of(0, 5, 2.0), of(1, 9, 3.0), of(1, 13, 4.0), of(7, 1, 90.0) + of(2, 20, 5.0), of(2, 21, 6.0)]
    board = boards.ended_runs_leave(_stream(spark, str(tmp_path / "log"), batches), "3 days", delay="1 hour")
    seen = []
    writer = board.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state"))
    query = writer.foreachBatch(lambda df, _: seen.append([tuple(r) for r in df.collect()])).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) >= 2 and held[-1] == 1
    rows = [r for batch in seen for r in batch]
    assert {r[0] for r in rows} == {0, 1, 2, 7} and all(r[4] < 90.0 for r in rows)


def test_metrics_of_a_run_share_a_state_row_and_end_alone(spark, tmp_path):
    def of(run, metric, day, value):
        return [(run, metric, dt.datetime(2024, 1, day, 0, i), i, value + i) for i in range(4)]

    # metric a of run 7 ends on day 1, b goes on; a comes back on day 25 and starts anew
    batches = [of(7, "a", 1, 50.0) + of(7, "b", 1, 1.0), of(7, "b", 3, 2.0), of(7, None, 6, 3.0), of(7, "b", 20, 4.0), of(7, "a", 25, 5.0)]
    board = boards.ended_runs_leave(_stream(spark, str(tmp_path / "log"), batches), "3 days", delay="1 hour", mode="max")
    seen = []
    writer = board.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state"))
    query = writer.foreachBatch(lambda df, _: seen.append(sorted((r.metric or "", r.value) for r in df.collect()))).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) == 1
    assert [rows for rows in seen if rows] == [[("a", 53.0), ("b", 4.0)], [("b", 5.0)], [("", 6.0)], [("b", 7.0)], [("a", 8.0)]]


def test_the_best_value_keeps_its_first_step(spark):
    rows = [(0, "m", dt.datetime(2024, 1, 1, 0, i), i, v) for i, v in enumerate([1.0, 5.0, 5.0, float("nan")])]
    row = boards.best_so_far(_log(spark, rows)).first()
    assert (row.value, row.step) == (5.0, 1)
    low = boards.best_so_far(_log(spark, rows), mode="min").first()
    assert (low.value, low.step) == (1.0, 0)


def test_board_reads_local_times_as_given(spark):
    row = boards.best_so_far(_log(spark, [(0, "m", dt.datetime(2024, 3, 31, 2, 30), 1, 1.0)]), period="1 day").first()
    assert row.period == dt.datetime(2024, 3, 31)


def test_bad_sheets_are_listed_and_the_others_read(spark, tmp_path):
    files = {
        "sheet.ann.csv": 'sample_id,a,Unnamed: 1\n1,"x\ny",0\n2,z,0\n',
        "sheet.bob.csv": "sample_id,a\n3,q\n",
        "sheet.bad.csv": "sample_id,a\n4,q\n5,q,more\n",
        "sheet.other.csv": "id,a\n6,q\n",
        "sheet.empty.csv": "",
        "sheet.header.csv": "sample_id,a\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    paths = [f"{tmp_path}/{n}" for n in [*files, "sheet.gone.csv"]]
    rows, ledger = sheets.scan_sheets(spark, paths, ["sample_id"])
    assert sorted((r.sample_id, r.a, r.file_annotator) for r in rows.collect()) == [("1", "x\ny", "ann"), ("2", "z", "ann"), ("3", "q", "bob")]
    got = {r.path.rsplit(".", 2)[1]: (r.n_rows, r.reason) for r in ledger.collect()}
    assert got == {
        "ann": (2, None), "bob": (1, None), "bad": (2, "1 rows of another length"), "other": (1, "lacks sample_id"),
        "empty": (0, "no header"), "header": (0, None), "gone": (0, "PATH_NOT_FOUND"),
    }
    none, only = sheets.scan_sheets(spark, [paths[-1]], ["sample_id"])
    assert none.count() == 0 and only.count() == 1
