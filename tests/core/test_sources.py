import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.sources import binary as B
from vecspark.sources import logs as L


@pytest.mark.parametrize("element", ["float", "uint8", "int8", "uint32"])
def test_matrix_round_trip(spark, tmp_path, element):
    rng = np.random.default_rng(0)
    x = rng.integers(0 if element[0] == "u" else -100, 100, (37, 5)).tolist()
    path = f"{tmp_path}/m.bin"
    rows = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)
    assert B.write_matrix(rows, path, element) == 37
    assert B.metadata(path) == (37, 5) and B.size(path) == 8 + 37 * 5 * np.dtype(B.ELEMENTS[element][0]).itemsize
    got = B.read_matrix(spark, path, element)
    assert [list(map(float, r.vec)) for r in got.orderBy("id").collect()] == x
    padded = B.read_matrix(spark, path, element, pad_to=8)
    assert {len(r.vec) for r in padded.collect()} == {8}
    many = spark.read.format("binmatrix").option("element", element).option("rowsBytes", "64").load(path)
    assert many.rdd.getNumPartitions() > 2 and many.count() == 37


def test_matrix_offsets_and_errors(spark, tmp_path):
    path = f"{tmp_path}/m.bin"
    open(path, "wb").write(b"xxxx" + struct.pack("<ii", 1, 2) + np.array([1, 2], "<f4").tobytes())
    assert B.read_matrix(spark, path, offset=4).first().vec == [1.0, 2.0]
    open(path, "wb").write(struct.pack("<ii", 9, 2))
    with pytest.raises(Exception, match="shorter"):
        B.read_matrix(spark, path).collect()
    with pytest.raises(ValueError):
        B.read_matrix(spark, path, "float64")
    with pytest.raises(ValueError):
        B.write_matrix(spark.createDataFrame([(3, [1.0])], "id long, vec array<double>"), path)


def test_truth_variants(spark, tmp_path):
    truth = spark.createDataFrame([(q, r, 10 * q + r, float(r)) for q in range(4) for r in range(1, 4)], "qid long, rank long, id long, dist double")
    path = f"{tmp_path}/t.bin"
    B.write_truth(truth, path)
    assert sorted(map(tuple, B.read_truth(spark, path).drop("tag").collect())) == sorted(map(tuple, truth.collect()))
    raw = open(path, "rb").read()
    open(path, "wb").write(raw[: 8 + 48])
    assert B.read_truth(spark, path).where("dist is null").count() == 12
    open(path, "wb").write(raw + np.arange(12, dtype="<u4").tobytes())
    assert B.read_truth(spark, path).agg(F.sum("tag")).first()[0] == 66
    open(path, "wb").write(raw[:-4])
    with pytest.raises(ValueError):
        B.read_truth(spark, path)


@pytest.mark.parametrize("dialect", ["degrees", "lists"])
def test_graph_files(spark, tmp_path, dialect):
    g = spark.createDataFrame([(0, [1, 2]), (1, []), (2, [0]), (3, [0, 1, 2])], "id long, nbrs array<long>")
    B.write_graph(g, f"{tmp_path}/g.bin", dialect)
    assert sorted(map(tuple, B.read_graph(spark, f"{tmp_path}/g.bin", dialect).collect())) == sorted(map(tuple, g.collect()))


def test_partition_lists(spark, tmp_path):
    open(f"{tmp_path}/p.txt", "w").write("3 1 2\n7, 8 \n\n5")
    got = sorted(map(tuple, B.read_partition_lists(spark, f"{tmp_path}/p.txt").collect()))
    assert got == [(1, 0), (2, 0), (3, 0), (5, 3), (7, 1), (8, 1)]
    B.write_partition_lists(spark.createDataFrame(got, "id long, partition_id int"), f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ["1 2 3", "7 8", "5"]


def test_client_log_and_names(spark, tmp_path):
    open(f"{tmp_path}/c.log", "w").write("noise 1 2\n  L  I/O Width QPS Recall@10\n=====\n  10  1  31920.25 1320.31 2963 13.26 0 13.76 546 58.82\n\nbye\n")
    r = L.client_table(spark, f"{tmp_path}/c.log").collect()
    assert len(r) == 1 and (r[0].L, r[0].beam, r[0].mean_cmps, r[0].recall_pct) == (10, 1, 546.0, 58.82)
    names = [("logs_STATE_SEND_distributed_bigann_100M_5_500_MS_x_BEAMWIDTH_8_t",), ("other",)]
    got = spark.createDataFrame(names, "n string").select(L.run_names(F.col("n")).alias("r")).select("r.*").collect()
    assert tuple(got[0]) == ("STATE_SEND", "bigann", "100M", 5, 8) and got[1].method is None


def test_query_csv_round_trip(spark, tmp_path):
    p = tmp_path / "result_L_20.csv"
    p.write_text("query_id,send_timestamp_ns,receive_timestamp_ns,completion_time_us,io_us,n_hops,n_ios,n_cmps,partition_history,partition_history_hop_idx\n7,1000,3000,1.5,0.5,3,4,5,[0,2,],[0,1,]\n8,1,2,3,4,5,6,7,[],[]\n")
    r = L.query_table(spark, str(p)).orderBy("query_id").collect()
    assert (r[0].L, r[0].query_id, r[0].n_cmps, r[0].partition_history, r[0].partition_history_hop_idx) == (20, 7, 5.0, [0, 2], [0, 1]) and r[1].partition_history == []
    L.write_query_table(L.query_table(spark, str(p)), f"{tmp_path}/out")
    assert L.query_table(spark, f"{tmp_path}/out").drop("L").orderBy("query_id").collect() == [x for x in L.query_table(spark, str(p)).drop("L").orderBy("query_id").collect()]


def test_counters(spark, tmp_path):
    s = 10**9
    (tmp_path / "a.csv").write_text(f"timestamp_ns,q,peer_0\n{5 * s},1,1\n{40 * s},2,3\n{41 * s},4,5\n")
    got = sorted((r.seconds, r.counter, r.value) for r in L.counters(spark, f"{tmp_path}/a.csv").collect())
    assert got == [(0.0, "peer_0", 3), (0.0, "q", 2), (1.0, "peer_0", 5), (1.0, "q", 4)]


def test_events(spark, tmp_path):
    (tmp_path / "e.log").write_text("[100] [1] [STATES]:BEGIN_HANDLER\n[100] [1] [STATES]:NUM_MSG 4\nnoise\n[350] [1] [STATES]:END_HANDLER\n[400] [2] [STATES]:BEGIN_HANDLER\n")
    e = L.events(spark, f"{tmp_path}/e.log")
    assert e.count() == 4
    d = L.event_durations(e).collect()
    assert [(r.msg_id, r.metric, r.duration, r.num_msg, r.visited_state) for r in d] == [(1, "handler", 250, 4, None)]
    s = L.duration_statistics(L.event_durations(e)).first()
    assert (s.n, s.mean_us, s.median_num_msg) == (1, 0.25, 4.0)


def test_tagged_logs(spark, tmp_path):
    (tmp_path / "t.dat").write_text(f"# c\n10 5000 1 {(3 << 32) + 9} 2 0\n11 7000 1 bad 2 0\n12 8000 1 77 2 0\n")
    (tmp_path / "tags.csv").write_text("# c\ntag_name,tag_value,msg_id_type\nX_START,10,query_id_and_node_id\nX_END,11,query_id_and_node_id\nY_SEND,12,batch_id\nY_RECEIVE,13,batch_id\nZ_START,14,query_id\n")
    tags = L.tag_dictionary(spark, f"{tmp_path}/tags.csv")
    assert sorted(map(tuple, L.tag_pairs(tags).collect())) == [(10, 11, "query_id_and_node_id"), (12, 13, "batch_id")]
    r = {x.tag: x for x in L.with_ids(L.tagged(spark, f"{tmp_path}/t.dat"), tags).collect()}
    assert (r[10].query_id, r[10].node_id, r[10].us) == (3, 9, 5.0) and not r[11].ok and r[12].batch_id == 77


def test_streams_that_end_leave_files(spark):
    """Their rows come from files, not from the driver's memory, and all of them are there."""
    from vecspark.plans.catalog import QUERIES

    for name, n in (("stream_parts_once", 1000), ("stream_waiting", 500)):
        out = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert out.inputFiles() and out.count() == n


def test_sql_functions_rank_no_pair_of_all(spark):
    """Windows see bounds and what is within them: no vectors, and far fewer rows than pairs."""
    from vecspark.plans.catalog import QUERIES

    plan = QUERIES["sql_functions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    windows, todo = [], [plan]
    while todo:
        p = todo.pop()
        kids = [p.children().apply(i) for i in range(p.children().size())]
        todo += kids
        windows += kids if p.nodeName() == "Window" else []
    assert windows and not any("array" in w.output().apply(i).dataType().simpleString() for w in windows for i in range(w.output().size()))
