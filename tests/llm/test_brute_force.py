"""Operators that SQL cannot express, against plain and slow versions of the same definitions."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from weftline.llm import ann, elias_fano, lm_trie, media, packing, queries, simhash
from weftline.sources.tables import table


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


@pytest.fixture(scope="module")
def texts(spark, data):
    return [(r.doc_id, r.text) for r in table(spark, data, "documents").collect()]


@pytest.mark.parametrize("n, top, crowd", [(0, 1, 0), (1, 5, 0), (1000, 50, 0), (20_000, 10**12, 0), (5000, 10**9, 3000)])
def test_elias_fano(n, top, crowd, tmp_path):
    rng = np.random.default_rng(n)
    v = np.sort(np.r_[rng.integers(0, top, n), rng.integers(top // 2, top // 2 + 4 * crowd + 1, crowd)])
    files = elias_fano.Files(str(tmp_path))
    e = elias_fano.EliasFano.of(files.map(files.write("v", elias_fano.EliasFano.build(v).arrays("v"))), "v")
    assert (e[np.arange(len(v))] == v).all()
    x = np.r_[rng.integers(0, top + 10, 2000), v[:1000], v[-1000:]]
    index, hit = e.find(x)
    assert (index == np.searchsorted(v, x)).all() and (hit == np.isin(x, v)).all()


def test_lm_scores(spark, data, texts):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts}
    one, two, three, n_docs = collections.Counter(), collections.Counter(), collections.Counter(), 0
    for i, t in texts:
        if not held[i]:
            s = ["<s>", *words(t), "<e>"]
            n_docs += 1
            one.update(s[1:])
            two.update(zip(s, s[1:]))
            three.update(zip(s, s[1:], s[2:]))
    total, distinct = sum(one.values()), len(one)
    steps = lambda p: math.ceil(-math.log10(p) / 0.03 - 1e-12)
    step = lambda p: 10 ** (-0.03 * steps(p)) if steps(p) < 255 else 0
    q2 = {k: step((c - 0.5) / (n_docs if k[0] == "<s>" else one[k[0]])) for k, c in two.items()}
    q3 = {k: step((c - 0.5) / two[k[:2]]) for k, c in three.items()}
    g2, g3 = collections.defaultdict(lambda: 1.0), collections.defaultdict(lambda: 1.0)
    for k, p in q2.items():
        g2[k[0]] -= p
    for k, p in q3.items():
        g3[k[:2]] -= p
    assert min(g2.values()) > 0 and min(g3.values()) > 0
    got = {r.doc_id: r for r in queries.op1_lm_scoring(spark, data).collect()}
    sums = collections.Counter()
    for i, t in texts:
        s = ["<s>", *words(t), "<e>"]
        base = score = 0.0
        for j in range(1, len(s)):
            p = u = (one[s[j]] + 0.1) / (total + 0.1 * (distinct + 1))
            p = q2.get((s[j - 1], s[j]), 0) + g2[s[j - 1]] * p
            if j > 1:
                p = q3.get((s[j - 2], s[j - 1], s[j]), 0) + g3[s[j - 2], s[j - 1]] * p
            base += math.log10(u)
            score += math.log10(p)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(s) - 1, sum(one[w] > 0 for w in s[1:]), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
        sums[held[i], "base"] += base
        sums[held[i], "score"] += score
    assert sums[True, "score"] > sums[True, "base"]


def components(fps, bits):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[:i]) <= bits):
            a, b = find(i), find(int(j))
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, data, texts):
    texts = sorted(texts)
    fps = []
    for _, t in texts:
        w = words(t)
        shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = components(np.array(fps, np.uint64), 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash_dedup(spark, data).collect()}
    assert got == {i: (f"{fp:016x}", texts[k][0]) for (i, _), fp, k in zip(texts, fps, root, strict=True)}


@pytest.mark.parametrize("bits, segments", [(4, 5), (4, 7), (3, 8), (2, 3)])
def test_links_of_crowds(spark, bits, segments):
    """Random fingerprints around a few centres, at distances about the bound, with one dense crowd."""
    rng = np.random.default_rng(bits * segments)
    fps = []
    for size, flips in ((300, 2), (60, 5), (60, 7), (1, 0)):
        centre = int(rng.integers(0, 1 << 63))
        for _ in range(size):
            fp = centre
            for b in rng.integers(0, 64, flips):
                fp ^= 1 << int(b)
            fps.append(fp)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    star = {r.u: r.root for r in simhash.stars(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits, segments)).collect()}
    want = components(np.array(fps, np.uint64), bits)
    assert len({star.get(f, f) for f in signed}) == len(set(want))
    groups = collections.defaultdict(set)
    for f, k in zip(signed, want, strict=True):
        groups[k].add(star.get(f, f))
    assert all(len(g) == 1 for g in groups.values())


def test_packing(spark, data, texts):
    model = Tokenizer.from_file(packing.tokenizer_path())
    got = collections.defaultdict(list)
    for r in queries.op5_best_fit_packing(spark, data).collect():
        got[r.doc_id].append(r)
    bins, total = collections.defaultdict(list), 0
    for i, t in texts:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(got[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
        total += len(ids)
        for r in own:
            bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.01 * -(-total // 2048) + 1


def test_tokens_are_the_tokenizers():
    odd = ["Straße ’quoted’ naïve <|endoftext|> x", "", "  ", "日本語 text İstanbul", "it's they're '' 'sx", "a\x1cb\x85c\xa0d", "é ² ½ ª", "\0 nul", "Ā raw", "don't!!'s 12ab"]
    memory = packing.Tokens(packing.tokenizer_path())
    for _ in range(2):
        ids, sizes = memory.encode(odd)
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        assert [p.tolist() for p in parts] == [memory.tokenizer.encode(t, add_special_tokens=False).ids for t in odd]


def brute_nearest(rows, every, k):
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    norm = np.sqrt((v * v).sum(axis=1))
    for q in np.flatnonzero(ids % every == 0):
        s = (v * v[q]).sum(axis=1) / (norm * norm[q])
        s[ids == ids[q]] = -9
        yield int(ids[q]), [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[:k]]


def test_nearest(spark, data):
    got = collections.defaultdict(dict)
    for r in queries.op8_nearest_neighbours(spark, data).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    rows = [(r.vec_id, r.embedding) for r in table(spark, data, "embeddings").collect()]
    for q, best in brute_nearest(rows, 50, 5):
        assert [got[q][n][0] for n in range(1, 6)] == [i for i, _ in best]
        assert [got[q][n][1] for n in range(1, 6)] == pytest.approx([s for _, s in best], abs=1e-12)


def test_nearest_relaxed_finds_most(spark, data):
    vectors = table(spark, data, "embeddings")
    exact, loose = ({(r.query_id, r.vec_id) for r in ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), relax=x, shard_rows=100).collect()} for x in (1.0, 1.1))
    assert len(exact & loose) >= 0.9 * len(exact)


def full_jpeg(width, height, ratios, blocks, restart):
    """A baseline JPEG with colour, alternating coefficients and restarts, written bit by bit."""
    ac_symbols = [0x00, 0xF0, *[r << 4 | s for r in range(4) for s in range(1, 6)]]
    dc_bits, ac_bits = [0] * 16, [0] * 16
    dc_bits[4], ac_bits[6] = 12, len(ac_symbols)
    bits, out = "", bytearray()

    def flush(last=False):
        nonlocal bits
        if last:
            bits += "1" * (-len(bits) % 8)
        while len(bits) >= 8:
            byte = int(bits[:8], 2)
            out.extend([byte, 0] if byte == 255 else [byte])
            bits = bits[8:]

    def number(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    before = [0] * len(ratios)
    for m, unit in enumerate(blocks):
        if restart and m and m % restart == 0:
            flush(True)
            out.extend([255, 0xD0 + (m // restart - 1) % 8])
            before = [0] * len(ratios)
        for part, dc, ac in unit:
            n, raw = number(dc - before[part])
            before[part] = dc
            bits += format(n, "05b") + raw
            at = 1
            for place, v in ac:
                run = place - at
                while run > 15:
                    bits += format(ac_symbols.index(0xF0), "07b")
                    run -= 16
                while run > 3:
                    n, raw = number(1)
                    bits += format(ac_symbols.index(3 << 4 | 1), "07b") + raw
                    run -= 4
                n, raw = number(v)
                bits += format(ac_symbols.index(run << 4 | n), "07b") + raw
                at = place + 1
            if at < 64:
                bits += format(0, "07b")
            flush()
    flush(True)
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(ratios)]) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(ratios))
    scan = bytes([len(ratios)]) + b"".join(bytes([k + 1, 0]) for k in range(len(ratios))) + bytes([0, 63, 0])
    seg = media.segment
    return bytes([255, 0xD8]) + seg(0xFE, b"a comment") + seg(0xDB, bytes([0]) + bytes([16] * 64)) + seg(0xC0, frame) + seg(0xC4, bytes([0, *dc_bits, *range(12)]) + bytes([0x10, *ac_bits, *ac_symbols])) + seg(0xDD, restart.to_bytes(2, "big")) + seg(0xDA, scan) + bytes(out) + bytes([255, 0xD9])


@pytest.mark.parametrize("width, height, ratios, restart", [(40, 24, [(1, 1)], 0), (40, 24, [(2, 2), (1, 1), (1, 1)], 2), (33, 17, [(2, 1), (1, 1), (1, 1)], 0), (16, 16, [(1, 1)], 1)])
def test_general_jpeg(width, height, ratios, restart):
    rng = np.random.default_rng(width)
    h, v = ratios[0]
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    blocks, grid = [], np.zeros((down * v, across * h), int)
    for m in range(across * down):
        unit = []
        for part, (ph, pv) in enumerate(ratios):
            for k in range(ph * pv):
                dc = int(rng.integers(-60, 60))
                ac = [(int(p), int(rng.integers(1, 15)) * (1 if rng.random() < 0.5 else -1)) for p in sorted(rng.choice(np.arange(1, 64), rng.integers(0, 6), replace=False))]
                unit.append((part, dc, ac))
                if part == 0:
                    grid[m // across * v + k // h, m % across * h + k % h] = dc
        blocks.append(unit)
    image = full_jpeg(width, height, ratios, blocks, restart)
    (parsed, thumb), = media.thumbnails([image])[0]
    assert (parsed.width, parsed.height) == (width, height)
    want = np.clip((grid[: -(-height // 8), : -(-width // 8)] * 16 + 4) // 8 + 128, 0, 255)
    assert (thumb == want).all()
    both = media.thumbnails([image, media.encode([media.padded(b"x")])[0], image + image])
    assert [len(x) for x in both] == [1, 1, 2] and (both[2][1][1] == want).all()


def test_media(spark, data, texts):
    got = {r.doc_id: r for r in queries.op10_media_columns(spark, data).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        if i < 20:
            stored = media.encode([payload])[0]
            assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_tall_payloads():
    payload = np.random.default_rng(0).integers(0, 256, 576 * 700, dtype=np.uint8).tobytes()
    stored = media.encode([payload, payload[:576]])
    images = media.thumbnails(stored)
    assert [len(x) for x in images] == [3, 1]
    assert b"".join(t.tobytes() for _, t in images[0]) == payload
