import numpy as np

from quillfold.llm import chroma as ch


def song(seed, notes=64):
    return (np.random.default_rng(seed).normal(0, 0.2, notes)).tolist()


def prints(vectors):
    return {k: ch.fingerprint(ch.chroma(ch.tones(v))) for k, v in vectors.items() if v}


def test_filters_read_rectangles():
    image = np.random.default_rng(0).random((30, 12))
    assert len(ch.fingerprint(image)) == 30 - ch.WIDTH + 1
    assert len(ch.fingerprint(image[: ch.WIDTH - 1])) == 0
    assert all(0 <= p and p + h <= 12 and 1 < w <= ch.WIDTH for _, p, h, w in ch.filters())


def test_a_cut_recording_aligns():
    pcm = ch.tones(song(1))
    whole, part = (ch.fingerprint(ch.chroma(x)) for x in (pcm, pcm[20 * ch.HOP :]))
    (found,) = ch.Index([7], [whole]).links(8, part)
    assert found[1:3] == (7, 20) and found[3] == 0
    noisy = ch.fingerprint(ch.chroma(pcm + np.random.default_rng(2).normal(0, 0.05, len(pcm)).astype(np.float32)))
    assert ch.Index([7], [whole]).links(8, noisy)[0][0] < 0.1
    assert ch.Index([7], [ch.fingerprint(ch.chroma(ch.tones(song(3))))]).links(8, whole) == []


def test_alignment_agrees_with_brute_force(spark):
    base = {i: song(i) for i in range(30)}
    for i in range(30, 50):
        v = list(base[i % 6])
        v[i % 64] += 1.0
        base[i] = v
    base |= {60: base[0], 61: base[0], 62: None, 63: [], 64: [0.1] * 3}
    df = spark.createDataFrame([(k, v, 1) for k, v in base.items()] + [(5, base[5], 2)], "vec_id long, embedding array<double>, class_id int")
    got = {r.id: r for r in ch.align(ch.fingerprints(df, "vec_id", "embedding", ch.tones), parts=3).collect()}
    fps = {k: f for k, f in prints(base).items() if len(f)}
    least = {f.tobytes(): min(k for k in fps if fps[k].tobytes() == f.tobytes()) for f in fps.values()}
    for k in base:
        if k not in fps:
            assert (got[k].class_id, got[k].n_ints, got[k].n_links) == (k, 0, 0)
            continue
        own = least[fps[k].tobytes()]
        links = []
        for q in sorted({least[fps[x].tobytes()] for x in fps if x % 20 == 0} - {own}):
            votes = {}
            a, b = ch.keys_of(fps[q]), ch.keys_of(fps[k])
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    if x == y:
                        votes[i - j] = votes.get(i - j, 0) + 1
            rows = []
            for offset, n in votes.items():
                errors, overlap = ch.bit_errors(fps[q], fps[k], offset)
                if n >= ch.VOTES and overlap >= ch.LEAST_OVERLAP * min(len(fps[q]), len(fps[k])) and errors <= ch.MOST_ERRORS * 32 * overlap:
                    rows.append((-overlap, errors / (32 * overlap), abs(offset), offset))
            if rows:
                links.append((min(rows)[1], q, min(rows)[3]))
        assert (got[k].class_id, got[k].n_links) == (own, len(links))
        if links:
            assert (got[k].best_query, got[k].best_offset) == min(links)[1:]
    assert ch.align(ch.fingerprints(df.limit(0), "vec_id", "embedding", ch.tones)).count() == 0


def every_offset(a, b):
    """Whether b lies on a at any offset."""
    for offset in range(1 - len(b), len(a)):
        errors, overlap = ch.bit_errors(a, b, offset)
        if overlap and overlap >= ch.LEAST_OVERLAP * min(len(a), len(b)) and errors <= ch.MOST_ERRORS * 32 * overlap:
            return True
    return False


def test_recall_against_every_offset():
    """Noisy and cut copies of every length: most links that scoring all offsets of all pairs finds are found, and no others."""
    for notes, least in ((5, 1.0), (8, 1.0), (18, 1.0), (24, 0.9), (36, 0.9), (64, 0.9), (200, 0.9)):
        rng, wanted, loud, found = np.random.default_rng(notes), set(), set(), set()
        whole = [ch.tones(song(1000 * notes + k, notes)) for k in range(40)]
        fps = [ch.fingerprint(ch.chroma(x)) for x in whole]
        index = ch.Index(list(range(40)), fps)
        for k, pcm in enumerate(whole):
            cut = int(rng.integers(0, max(1, notes // 3))) * ch.HOP + int(rng.choice([0, 64, 128]))
            noisy = (pcm + rng.normal(0, rng.choice([0.1, 0.2, 0.3, 0.4]), len(pcm)).astype(np.float32))[cut:]
            fp = ch.fingerprint(ch.chroma(noisy))
            found |= {(r[1], k) for r in index.links(-1, fp)} if len(fp) else set()
            wanted |= {(q, k) for q in range(40) if len(fp) and every_offset(fps[q], fp)}
            rate = min((ch.bit_errors(fps[k], fp, o)[0] / 32 / ch.bit_errors(fps[k], fp, o)[1] for o in range(len(fps[k]) // 2)), default=1) if len(fp) else 1
            loud |= {(k, k)} if 0.06 <= rate else set()
        assert found <= wanted
        assert len(wanted) > 5 and len(found) >= least * len(wanted)
        assert not wanted & loud or len(found & loud) >= 0.9 * len(wanted & loud)


def test_short_recordings_link_within_the_limit():
    a = np.random.default_rng(1).integers(0, 1 << 32, 4, dtype=np.uint32)
    b = a ^ np.array([15, 15, 15, 15], dtype=np.uint32)
    assert ch.Index([7], [a]).links(8, b) == [(16 / 128, 7, 0, 16, 4)]
    assert ch.Index([7], [a]).links(8, a ^ np.uint32(31)) == []
