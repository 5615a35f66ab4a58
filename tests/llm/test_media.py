import hashlib
import random
import struct
import zlib

from lattica.llm import media, queries


def texts():
    r = random.Random(1)
    return [None, "", "a", "x" * 63, "x" * 64, "x" * 65, "é漢🙂" * 10, "\u0000", *("".join(r.choices("abc é", k=r.randint(1, 3000))) for _ in range(30)), "long " * 40_000]


def test_lossless_round_trip():
    for text in texts():
        payload, n = media.padded(text)
        assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[:n] == (text or "").encode() and not payload[n:].strip(b"\0")
        assert len(payload) - n < 64 or n == 0
        data = media.container(payload)
        t = media.tracks(data)[0]
        assert media.payload_of(data, t) == payload and t["n_samples"] * 64 == len(payload) and t["codec"] == "raw "
        ranges = media.key_ranges(t)
        assert [data[a:z] for a, z in ranges] == [payload[k : k + 64] for k in range(0, len(payload), 64 * media.KEY_EVERY)]


def foreign(wide: bool, sizes: list[int], per_chunk: list[int], keys: list[int] | None, small: int = 0) -> tuple[bytes, list[bytes]]:
    """A container of another make: unequal sample sizes, other boxes between, version 1 header, mdat first."""
    samples = [bytes([i % 251] * n) for i, n in enumerate(sizes)]
    mdat, offsets, at, k = b"", [], 24 + 8 + 16, 0
    for n in per_chunk:
        offsets.append(at + len(mdat) + 3)
        mdat += b"gap" + b"".join(samples[k : k + n])
        k += n
    head = media.box(b"ftyp", b"iso5", b"\0" * 12) + media.box(b"free")
    body = struct.pack(">I4sQ", 1, b"mdat", len(mdat) + 16) + mdat
    size = media.box(b"stz2", b"\0" * 7, bytes([small]), struct.pack(">I", len(sizes)), bytes(sizes) if small == 8 else b"".join(bytes([(a << 4) | b]) for a, b in zip(sizes[::2], [*sizes[1::2], 0], strict=False))) if small else media.full(b"stsz", struct.pack(f">II{len(sizes)}I", 0, len(sizes), *sizes))
    at = media.full(b"co64", struct.pack(f">I{len(offsets)}Q", len(offsets), *offsets)) if wide else media.full(b"stco", struct.pack(f">I{len(offsets)}I", len(offsets), *offsets))
    stsc = media.full(b"stsc", struct.pack(">I", len(per_chunk)), *(struct.pack(">III", i + 1, n, 1) for i, n in enumerate(per_chunk)))
    tables = [media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", b"\0" * 40)), media.full(b"stts", struct.pack(">III", 1, len(sizes), 100)), stsc, size, at]
    if keys is not None:
        tables.append(media.full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)))
    mdhd = media.box(b"mdhd", b"\1\0\0\0", struct.pack(">QQIQ", 0, 0, 1000, 100 * len(sizes)), b"\0" * 4)
    moov = media.box(b"moov", media.box(b"udta", media.full(b"meta")), media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", media.box(b"stbl", *tables)))))
    return head + body + moov, samples


def test_containers_of_another_make():
    for wide, small in ((False, 0), (True, 0), (False, 8), (True, 4)):
        sizes = [3, 1, 7, 9, 2, 8, 5] if small != 4 else [3, 1, 7, 9, 2, 8, 5, 1]
        data, samples = foreign(wide, sizes, [3, 2, len(sizes) - 5], [1, 4, 7], small)
        t = media.tracks(data)[0]
        assert t["codec"] == "avc1" and t["timescale"] == 1000 and t["ticks"] == 100 * len(sizes)
        assert media.payload_of(data, t) == b"".join(samples)
        assert [data[a:z] for a, z in media.key_ranges(t)] == [samples[0], samples[3], samples[6]]
    data, samples = foreign(False, [2, 3], [2], None)
    assert [data[a:z] for a, z in media.key_ranges(media.tracks(data)[0])] == samples


def test_wide_containers():
    payload = media.padded("wide " * 500)[0]
    data = media.container(payload, wide=True)
    t, narrow = media.tracks(data)[0], media.tracks(media.container(payload))[0]
    assert media.payload_of(data, t) == payload and all(t[k] == narrow[k] for k in ("id", "codec", "timescale", "ticks", "n_samples", "keys"))
    assert [data[a:z] for a, z in media.key_ranges(t)] == [payload[k : k + 64] for k in range(0, len(payload), 64 * media.KEY_EVERY)]


def empty_track(number: int, codec: bytes) -> bytes:
    """A track whose samples are in fragments; its duration is left open."""
    stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(codec, b"\0" * 40)), *(media.full(k, b"\0" * 4) for k in (b"stts", b"stsc", b"stco")), media.full(b"stsz", b"\0" * 8))
    mdhd = media.full(b"mdhd", struct.pack(">IIII", 0, 0, 600, 0), b"\0" * 4)
    return media.box(b"trak", media.full(b"tkhd", struct.pack(">III", 0, 0, number), b"\0" * 68), media.box(b"mdia", mdhd, media.box(b"minf", stbl)))


def test_two_tracks_in_fragments():
    """Sizes, flags and offsets given by sample, by fragment and by track, in two fragments of two tracks."""
    trex = [media.full(b"trex", struct.pack(">IIIII", k, 1, 10, size, flags)) for k, size, flags in ((1, 0, media.SYNC), (2, 5, 0))]
    data = media.box(b"ftyp", b"iso5", b"\0" * 8) + media.box(b"moov", empty_track(1, b"avc1"), empty_track(2, b"mp4a"), media.box(b"mvex", *trex))
    want = {1: ([], []), 2: ([], [])}
    for turn in range(2):
        video, audio = [bytes([65 + turn]) * n for n in (7, 2, 4)], [bytes([97 + turn]) * 5] * 2

        def moof(offset, turn=turn):
            first = struct.pack(">IIiI", 0x205, 3, offset, 0) + struct.pack(">III", 7, 2, 4)
            one = media.box(b"traf", media.box(b"tfhd", struct.pack(">II", 0x20000, 1)), media.box(b"trun", first))
            second = struct.pack(">II", 0, 2)  # follows the data of the track before it
            if turn:
                second = struct.pack(">IIi", 1, 2, offset + 13)
            two = media.box(b"traf", media.box(b"tfhd", struct.pack(">II", 0x20000 if turn else 0, 2)), media.box(b"trun", second))
            return media.box(b"moof", media.full(b"mfhd", b"\0\0\0\1"), one, two)

        data += moof(len(moof(0)) + 8) + media.box(b"mdat", *video, *audio)
        want[1][0].extend(video)
        want[1][1].append(video[0])
        want[2][0].extend(audio)
        want[2][1].extend(audio)
    found = media.tracks(data)
    assert [(t["id"], t["codec"], t["n_samples"]) for t in found] == [(1, "avc1", 6), (2, "mp4a", 4)]
    for t in found:
        samples, keys = want[t["id"]]
        assert media.payload_of(data, t) == b"".join(samples)
        assert [data[a:z] for a, z in media.key_ranges(t)] == keys
    assert [x["codec"] for x in media.describe(data)[-1]] == ["avc1", "mp4a"]


def test_damage_never_raises():
    data, r = media.container(media.padded("some text " * 40)[0]), random.Random(4)
    for n in range(0, len(data), 7):
        assert len(media.describe(data[:n])) == 13
    for _ in range(400):
        broken = bytearray(data)
        for _ in range(r.randint(1, 6)):
            broken[r.randrange(len(broken))] = r.randrange(256)
        assert len(media.describe(bytes(broken))) == 13
    assert media.describe(b"")[-2] == "no track" and media.describe(None)[-2] == "no bytes"


def test_query(spark, tmp_path):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(None, "again", 1), (7, "again", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, media int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op8_media_columns"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x["doc_id"], []).append(x)
    for i, t, _ in rows[:-2]:
        payload, n = media.padded(t)
        assert any((x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) for x in by[i])
    same = [x for x in got if x["n_bytes"] == 5]
    assert len({(x["media_sha256"], x["feature"]) for x in same}) == 1 and len(same) == 2
    none = spark.createDataFrame([], "doc_id long, text string")
    assert media.read_media(media.store_text(none)).count() == 0
    files = spark.createDataFrame([(1, None, "keep"), (2, b"junk", "keep")], "codec int, media binary, other string")
    assert [(x["other"], x["codec"], x["error"] is None) for x in media.read_media(files).collect()] == [("keep", None, False)] * 2
