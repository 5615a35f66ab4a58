"""Media columns: ISO base media containers, written and read without touching sample payloads.

`read_media` walks the nested boxes of each container, decodes the sample tables (stsd, stts, stsz or stz2, stsc, stco
or co64, stss) of every track and those of movie fragments (trex, tfhd, trun), and gives codec, duration, sample count
and the byte ranges of keyframes: of the first track as columns, of all in `tracks`. It reads box headers and tables
only. Where the header leaves the duration open, it is the sum of the samples' durations. `store_text` puts a text's bytes into such a container as unsigned 8-bit samples ('raw '), 64 to a table
entry, losslessly; `read_payload` gets them back through the sample tables.

Defined results:
    null text             empty text: a payload of 64 zero bytes
    very long texts       whole (a Spark binary ends at 2 GB); `wide` writes 64-bit offsets and durations
    null bytes            all columns null, error "no bytes"
    damaged containers    columns null and `error` says what is wrong; never an exception
    repeated rows, ties   equal bytes give equal values; nothing of a row's identity enters the container
    empty table           empty result
    further columns       store_text keeps the identifier only; read_media keeps all columns but those it writes
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64  # bytes to a sample table entry
RATE = 8000  # 8-bit samples a second
CHUNK = 256  # entries to a chunk
KEY_EVERY = 16  # entries from keyframe to keyframe
#: Boxes that hold boxes, and how many bytes of their own come first.
NESTED = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"udta": 0, b"moof": 0, b"traf": 0, b"mvex": 0, b"meta": 4}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, b"\0\0\0\0", *parts)


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * ((-len(data)) % UNIT or (UNIT if not data else 0)), len(data)


def container(payload: bytes, wide: bool = False) -> bytes:
    """payload, a positive multiple of UNIT bytes, as one track. wide: 64-bit offsets, sizes and durations, which payloads of
    nearly 4 GiB need."""
    n = len(payload) // UNIT
    chunks = -(-n // CHUNK)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    wide = wide or len(payload) > 0xFFFF0000
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    runs = [(1, CHUNK)] if n % CHUNK == 0 else [(chunks, n % CHUNK)] if chunks == 1 else [(1, CHUNK), (chunks, n % CHUNK)]
    keys = range(1, n + 1, KEY_EVERY)
    entry = box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))

    def moov(first: int) -> bytes:
        at = [first + i * CHUNK * UNIT for i in range(chunks)]
        offsets = full(b"co64", struct.pack(f">I{chunks}Q", chunks, *at)) if wide else full(b"stco", struct.pack(f">I{chunks}I", chunks, *at))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, UNIT)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
            full(b"stsz", struct.pack(">II", UNIT, n)),
            offsets,
        )
        ticks, version, word = len(payload), bytes([wide, 0, 0]), "Q" if wide else "I"
        minf = box(b"minf", full(b"smhd", b"\0" * 4), box(b"dinf", full(b"dref", struct.pack(">I", 1), box(b"url ", b"\0\0\0\1"))), stbl)
        mdia = box(b"mdia", box(b"mdhd", version, b"\0", struct.pack(f">{word}{word}I{word}HH", 0, 0, RATE, ticks, 0x55C4, 0)), full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 12, b"text\0"), minf)
        tkhd = box(b"tkhd", version, b"\7", struct.pack(f">{word}{word}II{word}", 0, 0, 1, 0, ticks), b"\0" * 16, matrix, b"\0" * 8)
        mvhd = box(b"mvhd", version, b"\0", struct.pack(f">{word}{word}I{word}IH", 0, 0, RATE, ticks, 0x10000, 0x100), b"\0" * 10, matrix, b"\0" * 24, struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    size = len(moov(0))
    return ftyp + moov(len(ftyp) + size + len(head)) + head + payload


def walk(data, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int, int]]:
    """(path, start, body start, end) of every box, outer before inner. Raises ValueError on a box that leaves its parent."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                raise ValueError("cut box header")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        yield (*path, kind), start, body, stop
        if kind in NESTED:
            yield from walk(data, body + NESTED[kind], stop, (*path, kind))
        start = stop


def _track(data, spans: dict[bytes, tuple[int, int]]) -> dict:
    """What the boxes of one track say. spans: body start and end by kind."""

    def at(kind: bytes, form: str, skip: int = 4):
        a, z = spans[kind]
        if a + skip + struct.calcsize(form) > z:
            raise ValueError(f"cut box {kind!r}")
        return struct.unpack_from(form, data, a + skip)

    def rows(kind: bytes, form: str, skip: int = 4) -> list[tuple]:
        (n,) = at(kind, ">I", skip)
        a, z = spans[kind]
        step = struct.calcsize(">" + form)
        if a + skip + 4 + n * step > z:
            raise ValueError(f"cut box {kind!r}")
        return list(struct.iter_unpack(">" + form, data[a + skip + 4 : a + skip + 4 + n * step]))

    version = data[spans[b"mdhd"][0]]
    scale, ticks = at(b"mdhd", ">IQ", 20) if version else at(b"mdhd", ">II", 12)
    entry = at(b"stsd", ">II4s", 4)
    if b"stz2" in spans:
        _, bits, n = at(b"stz2", ">3sBI")
        a = spans[b"stz2"][0] + 12
        raw = data[a : a + -(-n * bits // 8)]
        sizes = [x for b in raw for x in (b >> 4, b & 15)][:n] if bits == 4 else [int.from_bytes(raw[i : i + bits // 8], "big") for i in range(0, n * bits // 8, bits // 8)]
        same = 0
    else:
        same, n = at(b"stsz", ">II")
        sizes = [] if same else [x for (x,) in rows(b"stsz", "I", 8)]
    chunks = [x for (x,) in (rows(b"co64", "Q") if b"co64" in spans else rows(b"stco", "I"))]
    plan = rows(b"stsc", "III")
    layout = []  # (offset, first entry, entries) of each chunk
    k = done = 0
    for i, offset in enumerate(chunks, 1):
        while k + 1 < len(plan) and plan[k + 1][0] <= i:
            k += 1
        if not plan:
            raise ValueError("no stsc")
        take = min(plan[k][1], n - done)
        layout.append((offset, done, take))
        done += take
    if done < n:
        raise ValueError("chunks hold too few samples")
    keys = [x - 1 for (x,) in rows(b"stss", "I")] if b"stss" in spans else None
    times = rows(b"stts", "II")
    if not ticks or ticks == (1 << (64 if version else 32)) - 1:
        ticks = sum(k * d for k, d in times)
    track = 0
    if b"tkhd" in spans:
        track = at(b"tkhd", ">I", 20 if data[spans[b"tkhd"][0]] else 12)[0]
    return {"id": track, "codec": entry[2].decode("latin-1"), "timescale": scale, "ticks": ticks, "n_samples": n, "same": same, "sizes": sizes, "layout": layout, "keys": keys}


SYNC = 0x10000  # set in the flags of a sample that is no keyframe


def _fields(data, a: int, z: int, forms: list[tuple[bool, str]]) -> list:
    """One value for each form, None where it is not there."""
    out = []
    for there, form in forms:
        if there and a + struct.calcsize(form) > z:
            raise ValueError("cut fragment")
        out.append(struct.unpack_from(form, data, a)[0] if there else None)
        a += struct.calcsize(form) if there else 0
    return [*out, a]


def _fragment(data, moof: int, traf: dict[bytes, list[tuple[int, int]]], by_id: dict, trex: dict, end: int) -> int:
    """Append a fragment's samples to their track. end: where the data of the one before it ended; returns where this ends."""
    if b"tfhd" not in traf:
        raise ValueError("no tfhd")
    a, z = traf[b"tfhd"][0]
    head, track, a = _fields(data, a, z, [(True, ">I"), (True, ">I")])
    base, _, _, size, flags, _ = _fields(data, a, z, [(head & 1, ">Q"), (head & 2, ">I"), (head & 8, ">I"), (head & 16, ">I"), (head & 32, ">I")])
    if track not in by_id:
        raise ValueError(f"no track {track}")
    t, (usual, usual_flags) = by_id[track], trex.get(track, (0, 0))
    size, flags = usual if size is None else size, usual_flags if flags is None else flags
    base = base if base is not None else moof if head & 0x20000 else end
    at = base
    if t["same"]:
        t["sizes"], t["same"] = [t["same"]] * t["n_samples"], 0
    t["keys"] = list(range(t["n_samples"])) if t["keys"] is None else t["keys"]
    for a, z in traf.get(b"trun", []):
        kind, n, a = _fields(data, a, z, [(True, ">I"), (True, ">I")])
        skip, first, a = _fields(data, a, z, [(kind & 1, ">i"), (kind & 4, ">I")])
        step = 4 * sum(bool(kind & x) for x in (0x100, 0x200, 0x400, 0x800))
        if a + n * step > z:
            raise ValueError("cut fragment")
        at = base + skip if skip is not None else at
        t["layout"].append((at, t["n_samples"], n))
        for i in range(n):
            _, own, mark, _, a = _fields(data, a, z, [(kind & 0x100, ">I"), (kind & 0x200, ">I"), (kind & 0x400, ">I"), (kind & 0x800, ">I")])
            mark = first if i == 0 and first is not None else flags if mark is None else mark
            if not mark & SYNC:
                t["keys"].append(t["n_samples"])
            t["sizes"].append(size if own is None else own)
            t["n_samples"] += 1
            at += t["sizes"][-1]
    return at


def tracks(data) -> list[dict]:
    """What the tables of each track say, fragments included."""
    found: list[dict[bytes, tuple[int, int]]] = []
    fragments: list[tuple[int, dict[bytes, list[tuple[int, int]]]]] = []
    moof, trex = 0, {}
    for path, start, a, z in walk(data):
        if path[-1] == b"trak":
            found.append({})
        elif found and b"trak" in path:
            found[-1].setdefault(path[-1], (a, z))
        elif path[-1] == b"moof":
            moof = start
        elif path[-1] == b"traf":
            fragments.append((moof, {}))
        elif b"traf" in path and fragments:
            fragments[-1][1].setdefault(path[-1], []).append((a, z))
        elif path[-1] == b"trex":
            _, track, _, _, size, flags, _ = _fields(data, a, z, [(True, ">I")] * 6)
            trex[track] = (size, flags)
    if not found:
        raise ValueError("no track")
    out = []
    for spans in found:
        if {b"mdhd", b"stsd", b"stsc", b"stts"} - spans.keys() or not {b"stsz", b"stz2"} & spans.keys() or not {b"stco", b"co64"} & spans.keys():
            raise ValueError("sample tables are missing")
        out.append(_track(data, spans))
    by_id = {t["id"]: t for t in reversed(out)}
    end, of = 0, None
    for moof, traf in fragments:
        end, of = (end if of == moof else moof), moof
        end = _fragment(data, moof, traf, by_id, trex, end)
    return out


def key_ranges(t: dict) -> list[tuple[int, int]]:
    """Byte ranges (start, end) of the keyframes; all entries where no stss says otherwise."""
    wanted = iter(range(t["n_samples"]) if t["keys"] is None else t["keys"])
    out, key = [], next(wanted, None)
    for offset, first, n in t["layout"]:
        at, pos = first, offset
        while key is not None and key < first + n:
            pos += t["same"] * (key - at) if t["same"] else sum(t["sizes"][at:key])
            size = t["same"] or t["sizes"][key]
            out.append((pos, pos + size))
            at, pos = key + 1, pos + size
            key = next(wanted, None)
    return out


def payload_of(data, t: dict) -> bytes:
    return b"".join(data[o : o + (t["same"] * n if t["same"] else sum(t["sizes"][f : f + n]))] for o, f, n in t["layout"])


def store_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (before padding), media (the container)."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.columns
            for i in range(0, len(ids), 500):
                made = [padded(x.as_py()) for x in texts[i : i + 500]]
                yield pa.RecordBatch.from_arrays([ids[i : i + 500], pa.array([n for _, n in made], pa.int64()), pa.array([container(p) for p, _ in made], pa.binary())], [id_col, "n_bytes", "media"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
TRACK = pa.struct([("track", pa.int64()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(SPAN))])
SCHEMA = pa.schema([("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(SPAN)), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string()), ("tracks", pa.list_(TRACK))])
SPANS = "array<struct<start:long,end:long>>"
READ = f"codec string, timescale long, duration double, n_samples long, keyframes {SPANS}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string, tracks array<struct<track:long,codec:string,timescale:long,duration:double,n_samples:long,keyframes:{SPANS}>>"


def described(t: dict) -> dict:
    seconds = t["ticks"] / t["timescale"] if t["timescale"] else None
    return {"track": t["id"], "codec": t["codec"], "timescale": t["timescale"], "duration": seconds, "n_samples": t["n_samples"], "keyframes": [{"start": a, "end": z} for a, z in key_ranges(t)]}


def describe(data: bytes | None) -> tuple:
    """The values of SCHEMA."""
    if data is None:
        return (None,) * 11 + ("no bytes", None)
    whole = (len(data), hashlib.sha256(data).hexdigest())
    try:
        found = tracks(data)
        every = [described(t) for t in found]
        back = payload_of(data, found[0])
    except (ValueError, struct.error, IndexError, KeyError) as e:
        return (None,) * 8 + (*whole, None, str(e), None)
    t = every[0]
    packed = b"".join(struct.pack(">QQ", r["start"], r["end"]) for r in t["keyframes"])
    feature = f"codec={t['codec'].strip()};seconds={t['duration']};entries={t['n_samples']};keyframes={len(t['keyframes'])};ranges={zlib.crc32(packed):08x}"
    return (t["codec"], t["timescale"], t["duration"], t["n_samples"], t["keyframes"], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), *whole, feature, None, every)


def read_media(files: DataFrame, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """files' columns (or those in keep) without the media, and the columns of READ."""
    own = set(SCHEMA.names)
    keep = [c for c in (keep or files.columns) if c != media_col and c not in own]
    kinds = dict(files.dtypes)

    def run(batches):
        for batch in batches:
            media = batch.column(len(keep))
            for i in range(0, len(media), 500):
                got = list(zip(*(describe(x.as_py()) for x in media[i : i + 500]), strict=True))
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[i : i + 500] for k in range(len(keep))), *(pa.array(c, f.type) for c, f in zip(got, SCHEMA, strict=True))], [*keep, *SCHEMA.names])

    return files.select(*keep, media_col).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), READ]))
