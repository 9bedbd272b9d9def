import base64
import hashlib
import random
import struct

import pytest
import zstandard

from starling.llm import warc as W


def corpus():
    rng = random.Random(4)
    rows = [(i, f"https://a.example/{i}?q=%20", rng.choice(["<p>one", "<p>two", "é" * 50, ""])) for i in range(120)]
    return rows + [(200, None, None), (201, "x\r\nWARC-Type: evil", "<b>"), (202, "u", "z" * 700_000), (None, "n", "<p>one"), (None, "n", "only here"), (7, rows[7][1], rows[7][2]), (300, "u", "\r\n\r\nWARC/1.1\r\n")]


def slow(rows, least=0):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        head = first.get(html or "")
        again = head is not None and page != head and len(raw) >= least
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", head if again else None))
    return sorted(out, key=str)


def frame(spark, rows, kind="long"):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], f"page_id {kind}, url string, html string, digest string, refers_to int")


def test_round_trip(spark, tmp_path):
    rows = corpus()
    for least in (0, 3):
        settings = W.Settings(frame_bytes=2000, bundle_bytes=300, least_revisit=least)
        index = W.write_archive(frame(spark, rows), f"{tmp_path}/a{least}", settings)
        got = W.read_archive(index)
        assert sorted(map(tuple, got.drop("url").collect()), key=str) == slow(rows, least)
        urls = {r.page_id: r.url for r in got.collect()}
        assert urls[5] == rows[5][1] and urls[200] == "about:blank" and "\r" not in urls[201]
    places = index.collect()
    assert len({r.path for r in places}) > 4 and not list(tmp_path.glob("*/*draft*"))
    for r in places[:40]:
        reader = W.BundleReader(r.path)
        assert reader.record(r.frame, r.offset)["page_id"] == r.page_id
        reader.close()


def test_bundles_are_plain_zstandard_with_a_seek_table(spark, tmp_path):
    index = W.write_archive(frame(spark, corpus()).coalesce(1), str(tmp_path / "a"), W.Settings(frame_bytes=5000))
    for path in {r.path for r in index.collect()}:
        raw = open(path, "rb").read()
        with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as r:
            plain = r.read()
        at = 0
        while at < len(plain):
            _, at = W.parse(plain, at)
        count, flags, magic = struct.unpack("<IBI", raw[-9:])
        assert magic == 0x8F92EAB1 and flags == 0
        sizes = list(struct.iter_unpack("<II", raw[-9 - 8 * count : -9]))
        assert sum(s[1] for s in sizes) == len(plain) and sum(s[0] for s in sizes) + 8 + 8 * count + 9 == len(raw)
        assert struct.unpack("<II", raw[sum(s[0] for s in sizes) :][:8]) == (0x184D2A5E, 8 * count + 9)


def test_damage_is_seen():
    raw = bytearray(W.record(1, "u", b"payload", None, False, "2000-01-01T00:00:00Z"))
    raw[raw.index(b"payload")] = ord("q")
    try:
        W.parse(bytes(raw))
    except ValueError:
        return
    raise AssertionError


def test_empty_table(spark, tmp_path):
    assert W.read_archive(W.write_archive(frame(spark, corpus()).limit(0), str(tmp_path / "e"))).count() == 0


def test_shuffled_revisits_equal_broadcast_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BROADCAST_ROWS", 0)
    got = W.read_archive(W.write_archive(frame(spark, corpus()), str(tmp_path / "s"))).drop("url").collect()
    assert sorted(map(tuple, got), key=str) == slow(corpus())


def test_text_ids(spark, tmp_path):
    rows = [("b", "u", "<p>same"), ("a/ >\r\n", "u", "<p>same"), ("none", "u", "x"), ("text:5", "u", "y"), (None, "u", "y"), ("é", "u", "z")]
    got = W.read_archive(W.write_archive(frame(spark, rows, "string"), str(tmp_path / "t"))).drop("url").collect()
    assert sorted(map(tuple, got), key=str) == slow(rows)
    with pytest.raises(TypeError):
        W.write_archive(frame(spark, [], "double"), str(tmp_path / "d"))


def test_tasks_follow_the_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "READ_LEAST", 1 << 12)
    rng = random.Random(2)
    rows = [(i, "u", "".join(rng.choices("abcdefgh ", k=2000))) for i in range(60)]
    index = W.write_archive(frame(spark, rows).coalesce(2), str(tmp_path / "p"), W.Settings(frame_bytes=4000))
    assert W.read_archive(index).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(W, "READ_MOST", 10_000)
    assert W.read_archive(index).rdd.getNumPartitions() > 11


def test_query(spark, tmp_path):
    rows = [r for r in corpus() if r[0] is not None]
    frame(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, W.op10_warc(spark, str(tmp_path)).collect()), key=str) == slow(rows)
