import hashlib
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import media as M

BYTES = st.one_of(st.binary(max_size=4000), st.lists(st.sampled_from([b"a", b"ab", b"\xff" * 50, b"the "]), max_size=600).map(b"".join))


@settings(max_examples=80, deadline=None)
@given(BYTES)
def test_codecs_give_back_what_they_took(data):
    assert M.unpackbits(M.packbits(data), len(data)) == data
    assert M.unlzw(M.lzw(data), len(data)) == data


def test_lzw_over_full_tables():
    data = bytes(i * i % 251 for i in range(60_000))
    assert M.unlzw(M.lzw(data), len(data)) == data


def test_known_streams():
    # the example of the PackBits format, and an LZW stream: clear, 7, then 258 = (7, 7), 8, end
    assert M.unpackbits(bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA"), 24) == bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22" + "AA" * 10)
    codes = [256, 7, 258, 8, 257]
    bits = int("".join(f"{c:09b}" for c in codes) + "000", 2).to_bytes(6, "big")
    assert M.unlzw(bits, 4) == bytes([7, 7, 7, 8]) and M.lzw(bytes([7, 7, 7, 8])) == bits


@pytest.mark.parametrize("n", [0, 1, 576, 577, 1152, 1153, 36864, 36865, 120_000])
def test_files_give_back_their_payload(n):
    payload = M.padded(bytes(i % 89 for i in range(n)))
    assert len(payload) % 576 == 0 and len(payload) >= max(576, n)
    pages = M.read_pages(M.write_tiff(payload))
    assert b"".join(p["pixels"] for p in pages) == payload and [p["page"] for p in pages] == list(range(len(pages)))
    assert {p["compression"] for p in pages} <= {M.LZW, M.DEFLATE, M.PACKBITS}


def test_big_endian_with_short_fields_and_two_strips():
    raw = bytes(range(12))
    entries = [(256, 3, 1, 4 << 16), (257, 3, 1, 3 << 16), (258, 3, 1, 8 << 16), (259, 3, 1, 1 << 16), (273, 3, 2, 8 << 16 | 16), (278, 3, 1, 2 << 16), (279, 3, 2, 8 << 16 | 4)]
    file = b"MM\0*" + struct.pack(">I", 20) + raw + struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHII", *e) for e in entries) + b"\0" * 4
    (page,) = M.read_pages(file)
    assert page["pixels"] == raw and (page["width"], page["height"]) == (4, 3)


@pytest.mark.parametrize("data", [None, b"", b"xx", b"II*\0\xff\xff\0\0", b"II*\0\x08\0\0\0\0\0\x08\0\0\0"])
def test_malformed_files_give_one_error(data):
    (page,) = M.read_pages(data)
    assert page["error"]


def tiff(width, height, samples, scheme, blocks, rows=None, tile=None, predictor=None, order="<"):
    """A file laid out apart from the writer: directory first, short fields, then the arrays and the blocks."""
    offset_tag, size_tag = (324, 325) if tile else (273, 279)
    fields = {256: ("H", [width]), 257: ("H", [height]), 258: ("H", [8] * samples), 259: ("H", [scheme]), 262: ("H", [1 if samples == 1 else 2]), 277: ("H", [samples]), offset_tag: ("I", [0] * len(blocks)), size_tag: ("I", [len(b) for b in blocks])}
    if tile:
        fields |= {322: ("H", [tile[0]]), 323: ("H", [tile[1]])}
    else:
        fields[278] = ("H", [rows])
    if predictor:
        fields[317] = ("H", [predictor])
    at = 8 + 2 + 12 * len(fields) + 4
    place = at + sum(struct.calcsize(order + f"{len(v)}{k}") for k, v in fields.values() if struct.calcsize(order + f"{len(v)}{k}") > 4)
    for i, b in enumerate(blocks):
        fields[offset_tag][1][i] = place
        place += len(b)
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, len(fields))
    entries, arrays = b"", b""
    for tag, (kind, values) in sorted(fields.items()):
        packed = struct.pack(order + f"{len(values)}{kind}", *values)
        if len(packed) > 4:
            arrays, packed = arrays + packed, struct.pack(order + "I", at + len(arrays))
        entries += struct.pack(order + "HHI", tag, 3 if kind == "H" else 4, len(values)) + packed.ljust(4, b"\0")
    return head + entries + b"\0" * 4 + arrays + b"".join(blocks)


def plain_lzw(data):
    """LZW as the format's text has it: codes of ever more bits, one code early, cleared when the table is full."""
    out, table, width = "", None, 9
    text = [bytes([b]) for b in data]
    string = b""
    out += f"{256:09b}"
    table = {bytes([i]): i for i in range(256)}
    free = 258
    for c in text:
        if string + c in table:
            string += c
            continue
        out += f"{table[string]:0{width}b}"
        table[string + c] = free
        free += 1
        if free in (512, 1024, 2048):
            width += 1
        if free == 4094:
            out += f"{256:0{width}b}"
            table, free, width = {bytes([i]): i for i in range(256)}, 258, 9
        string = c
    out += f"{table[string]:0{width}b}"
    free += 1
    width += free in (512, 1024, 2048)
    out += f"{257:0{width}b}"
    return int(out.ljust(-(-len(out) // 8) * 8, "0"), 2).to_bytes(-(-len(out) // 8), "big")


PACK = {1: bytes, 8: zlib.compress, 32946: zlib.compress, 5: plain_lzw, 32773: lambda b: b"".join(bytes([len(b[i : i + 100]) - 1]) + b[i : i + 100] for i in range(0, len(b), 100))}


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("predictor", [None, 1, 2])
@pytest.mark.parametrize("scheme", list(PACK))
@pytest.mark.parametrize("tiled", [False, True])
def test_files_of_another_writer(scheme, tiled, predictor, order):
    width, height, samples = 70, 37, 3
    image = [[[(x * 7 + y * y + c * 31 + (x * y) % 11) % 256 for c in range(samples)] for x in range(width)] for y in range(height)]

    def block(x0, y0, w, h):
        out = bytearray()
        for y in range(y0, y0 + h):
            for x in range(x0, x0 + w):
                for c in range(samples):
                    value = lambda u: image[y][u][c] if y < height and u < width else 0
                    out.append((value(x) - (value(x - 1) if x > x0 else 0)) % 256 if predictor == 2 else value(x))
        return PACK[scheme](bytes(out))

    if tiled:
        file = tiff(width, height, samples, scheme, [block(x, y, 32, 16) for y in range(0, height, 16) for x in range(0, width, 32)], tile=(32, 16), predictor=predictor, order=order)
    else:
        file = tiff(width, height, samples, scheme, [block(0, y, width, min(10, height - y)) for y in range(0, height, 10)], rows=10, predictor=predictor, order=order)
    (page,) = M.read_pages(file)
    assert page["pixels"] == bytes(v for row in image for p in row for v in p) and page["compression"] == scheme


def test_a_page_that_shrinks_a_thousandfold():
    data = bytes(2700 * 2700)
    packed = M.lzw(data)
    assert len(data) > 1032 * (len(packed) + 200) and M.unlzw(packed, len(data)) == data
    (page,) = M.read_pages(tiff(2700, 2700, 1, 5, [packed], rows=2700))
    assert page["pixels"] == data


def test_what_it_does_not_know_is_an_error():
    for file in (tiff(4, 4, 1, 1, [bytes(16)], rows=4, predictor=3), tiff(4, 4, 1, 7, [bytes(16)], rows=4), tiff(60_000, 60_000, 3, 5, [bytes(99)], rows=60_000)):
        (page,) = M.read_pages(file)
        assert page["error"]


def test_cut_files_never_crash():
    file = M.write_tiff(M.padded(b"some text " * 900))
    for n in range(0, len(file), 13):
        assert M.read_pages(file[:n])[-1].get("error")


def test_query(spark, folder, docs):
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in M.op6_media_tiff(spark, folder).collect():
        payload, file = M.padded(texts[r.doc_id]), M.write_tiff(M.padded(texts[r.doc_id]))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest()) and r.feature


def test_odd_rows(odd, empty):
    stored = M.store_texts(odd)
    assert stored.count() == odd.count() and M.page_rows(stored).where("error is not null").count() == 0
    assert M.page_rows(M.store_texts(empty)).count() == 0


def test_every_directory_field_may_be_wrong():
    """Any value in any part of any field: an error at most."""
    draw = random.Random(4)
    for n in (600, 9000):
        file = M.write_tiff(M.padded(bytes(draw.randrange(32, 127) for _ in range(n))))
        (at,) = struct.unpack_from("<I", file, 4)
        places = []
        while at:
            (entries,) = struct.unpack_from("<H", file, at)
            places += [(at, 2)] + [(at + 2 + 12 * i + k, size) for i in range(entries) for k, size in ((0, 2), (2, 2), (4, 4), (8, 4), (8, 2))] + [(at + 2 + 12 * entries, 4)]
            (at,) = struct.unpack_from("<I", file, at + 2 + 12 * entries)
        for place, size in places:
            for value in (0, 1, 2, 255, 65535, (1 << 8 * size) - 1, 1 << 8 * size - 1, draw.randrange(1 << 8 * size), draw.randrange(len(file))):
                changed = bytearray(file)
                changed[place : place + size] = (value % (1 << 8 * size)).to_bytes(size, "little")
                for page in M.read_pages(bytes(changed)):
                    assert "error" in page or len(page["pixels"]) == page["width"] * page["height"] * page["samples"]
