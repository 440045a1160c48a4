import os
import struct

import numpy as np
import pytest

from seedflow.operators import weights
from seedflow.operators.graph import Graph
from seedflow.sources import binary as B


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def plain(path):
    """The file read as its layout is told, without Spark."""
    data = open(path, "rb").read()
    mark, direction, bits, n, m = struct.unpack("<5Q", data[:40])
    ids = np.frombuffer(data, "<u4", n, 40)
    begins = np.frombuffer(data, "<u8", n + 1, 40 + 4 * n)
    other = np.frombuffer(data, "<u4", m, 40 + 4 * n + 8 * (n + 1))
    weight = np.frombuffer(data, {32: "<f4", 16: "<u2", 8: "<u1"}[bits], m, 40 + 4 * n + 8 * (n + 1) + 4 * m)
    edges = [(v, int(other[e]), float(weight[e])) for v in range(n) for e in range(int(begins[v]), int(begins[v + 1]))]
    return mark, direction, bits, ids.tolist(), edges


@pytest.mark.parametrize("bits", [32, 16, 8])
def test_round_trip_and_layout(club, tmp_path, bits, monkeypatch):
    path = str(tmp_path / "g.bin")
    B.write_binary(club, path, bits)
    mark, direction, found, ids, edges = plain(path)
    assert (mark, direction, found) == (0xC0FFEE, 0xF0CACC1A, bits) and ids == list(range(1, 35)) and os.listdir(tmp_path) == ["g.bin"]
    weight = {32: 0.5, 16: 32767.0, 8: 127.0}[bits]
    assert edges == [(s, d, weight) for s, d in rows(club.edges, "src", "dst")]
    back = B.read_binary(club.edges.sparkSession, path, "forward", bits)
    assert rows(back.edges, "src", "dst", "k", "eh") == rows(club.edges, "src", "dst", "k", "eh") and rows(back.vertices, "orig", "vid") == rows(club.vertices, "orig", "vid")
    want = club.edges if bits == 32 else weights.quantize(club.edges, bits)
    assert rows(back.edges, "src", "dst", "thr") == rows(want, "src", "dst", "thr")


def test_backward_graphs_parallel_edges_and_loops(spark, tmp_path):
    g = Graph.build(spark.createDataFrame([(5, 9, 0.25), (5, 9, 0.5), (9, 9, 1.0), (7, 5, 0.125)], "src long, dst long, weight double")).transpose()
    path = str(tmp_path / "g.bin")
    B.write_binary(g, path)
    assert plain(path)[1] == 0xA1CCAC0F
    back = B.read_binary(spark, path, "backward")
    assert back.direction == "backward" and rows(back.edges, "src", "dst", "weight") == rows(g.edges, "src", "dst", "weight")


def test_small_ranges_give_the_same(club, tmp_path, monkeypatch):
    path = str(tmp_path / "g.bin")
    B.write_binary(club, path)
    reader = B.GraphReader(path, "edges")
    monkeypatch.setattr(B, "RANGE", 7)
    monkeypatch.setattr(B, "BATCH", 3)
    got = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(reader.partitions()) == 12 and got == [(s, d, w) for s, d, w in rows(club.edges, "src", "dst", "weight")]


def test_wrong_files_raise(spark, club, tmp_path):
    path = str(tmp_path / "g.bin")
    B.write_binary(club, path)
    data = open(path, "rb").read()
    for k, bad in enumerate((b"\0" * 40 + data[40:], data[:8] + b"\1" * 8 + data[16:], data[:16] + struct.pack("<Q", 24) + data[24:], data[:-1], data[:20])):
        (tmp_path / f"bad{k}").write_bytes(bad)
        with pytest.raises(ValueError):
            B.read_binary(spark, str(tmp_path / f"bad{k}"))
    for how in ({"direction": "backward"}, {"bits": 8}, {"scale": 1.5}):
        with pytest.raises(ValueError):
            B.read_binary(spark, path, **how)
    assert {r["weight"] for r in B.read_binary(spark, path, scale=0.5).edges.collect()} == {0.25}
    big = Graph.build(spark.createDataFrame([(1, 1 << 33, 0.5)], "src long, dst long, weight double"))
    with pytest.raises(ValueError):
        B.write_binary(big, str(tmp_path / "big"))


def test_command_line(spark, club_edges, tmp_path):
    from seedflow import cli

    (tmp_path / "club.tsv").write_text("".join(f"{a} {b} {w}\n" for a, b, w in club_edges))
    cli.main(["dump-graph", "-i", str(tmp_path / "club.tsv"), "-w", "-o", str(tmp_path / "g.bin"), "--published", "--transpose"], spark)
    got = cli.main(["imm", "-i", str(tmp_path / "g.bin"), "--reload-binary", "-o", str(tmp_path / "o.json"), "-k", "2", "--rrsets", "30"], spark)[0]
    assert len(got["Seeds"]) == 2
