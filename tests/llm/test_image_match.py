import numpy as np

from millrace.llm import image_match as M
from millrace.llm.links import layout


def picture(seed, side=128):
    return M.draw(np.random.default_rng(seed).normal(size=(1, 64)))[0] if side == M.SIDE else np.kron(M.draw(np.random.default_rng(seed).normal(size=(1, 64)))[0], np.ones((2, 2), np.uint8))[:side, :side]


def table(spark, rows):
    return spark.createDataFrame(rows, "image_id long, image binary")


def test_copies_are_found_and_others_not(spark):
    rows = []
    for s in range(12):
        p = picture(s, M.SIDE)
        rows.append((s, M.encode(p)))
        rows.append((100 + s, M.encode(np.clip(p.astype(int) * 0.8 + 20, 0, 255).astype(np.uint8))))  # other light
        rows.append((200 + s, M.encode(p[8:90, 10:94])))  # cropped
        rows.append((300 + s, M.encode(np.rot90(p))))  # turned
    got = {(r.image_a, r.image_b) for r in M.copies(table(spark, rows)).collect()}
    assert all(a % 100 == b % 100 for a, b in got)
    want = {(min(a, b), max(a, b)) for s in range(12) for a in (s,) for b in (100 + s, 200 + s, 300 + s)}
    assert len(got & want) >= 0.9 * len(want)


def test_transform_of_a_crop(spark):
    p = picture(3, M.SIDE)
    (r,) = M.copies(table(spark, [(1, M.encode(p)), (2, M.encode(p[10:, 6:]))])).collect()
    assert abs(r.scale - 1) < 0.05 and abs(r.rotation) < 0.05 and abs(r.dx + 6) < 1.5 and abs(r.dy + 10) < 1.5


def test_table_join_keeps_what_brute_force_finds(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(25, 64))
    vectors = np.concatenate([base, base + rng.normal(scale=0.05, size=base.shape)])
    pictures = M.draw(vectors)
    described = M.describe(pictures)
    brute = set()
    for a in range(50):
        for b in range(a + 1, 50):
            made = M.consensus(*described[a], *described[b])
            if made and made[1] >= M.MIN_INLIERS:
                brute.add((a, b))
    got = {(r.image_a, r.image_b) for r in M.copies(table(spark, [(i, M.encode(p)) for i, p in enumerate(pictures)])).collect()}
    assert got <= brute and len(got) >= 0.9 * len(brute) and len(brute) >= 25


def test_awkward_rows(spark):
    good = M.encode(picture(1, M.SIDE))
    rows = [(1, None), (None, good), (2, b""), (3, b"P5 3 3 255\n123"), (4, b"GIF89a"), (5, b"P5 200 200 255\n" + b"\x00" * 10), (6, M.encode(np.full((96, 96), 9, np.uint8))), (7, good), (7, good), (8, good)]
    assert M.copies(table(spark, rows)).count() == 0  # equal files are one image there
    flat = rows[8 - 2][1]  # nothing to describe, but its equals are copies all the same
    rows += [(9, flat), (9, flat)]
    got = M.linked_images(table(spark, rows)).collect()
    assert sorted(map(tuple, got)) == [(6, 6, 1), (7, 7, 1), (8, 7, 1), (9, 6, 1)]
    assert M.copies(table(spark, [])).count() == 0 and M.linked_images(table(spark, [])).count() == 0
    assert {tuple(r) for r in M.membership(table(spark, rows)).collect() if r[0] != r[1]} == {(8, 7), (9, 6)}


def test_one_row_for_each_linked_image(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(8, 64))
    pictures = [M.encode(p) for p in M.draw(np.concatenate([base, base[:4] + rng.normal(scale=0.04, size=(4, 64)), base[:2] + rng.normal(scale=0.04, size=(2, 64))]))]
    rows = list(enumerate(pictures)) + [(100, pictures[0]), (101, pictures[8]), (102, pictures[7]), (200, pictures[4]), (200, pictures[5])]
    df = table(spark, rows).selectExpr("*", "'mine' AS class", "1 AS place", "2 AS digest")
    pairs = {(r.image_a, r.image_b) for r in M.copies(df).collect()}
    same = {i: {j for j, q in rows if q == p and j != i} for i, p in rows}
    first = {i: min({i} | same[i]) for i, _ in rows}
    links = {i: set(same[i]) for i, _ in rows}
    for a, b in pairs:
        for x in (i for i, _ in rows if first[i] == a):
            for y in (i for i, _ in rows if first[i] == b):
                links[x].add(y), links[y].add(x)
    links[200] = {4, 5}

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        return seen

    for i in links:
        for j in list(links[i]):
            links[j].add(i)
    want = {(i, min(reach(i)), len(links[i])) for i in links if links[i]}
    for most in (M.TASK_ROWS, 40):  # 40: cells of the tables are parted and paired part by part
        assert {tuple(r) for r in M.linked_images(df, most=most).collect()} == want, most


def test_parted_cells_give_the_same_pairs(spark):
    df = table(spark, [(i, M.encode(np.clip(picture(i // 6).astype(int) + i % 6, 0, 255).astype(np.uint8))) for i in range(24)])
    whole, parted = ({(r.image_a, r.image_b, r.inliers) for r in M.copies(df, most=m).collect()} for m in (M.TASK_ROWS, 15))
    assert whole == parted and len(whole) == 4 * 15


def test_near_keys_in_slices(monkeypatch):
    monkeypatch.setattr(M, "AT_ONCE", 7)
    key = np.random.default_rng(1).integers(0, 64, 60)
    got = [tuple(sorted(map(int, p))) for i, j in M.near_keys(key, 4) for p in zip(i, j)]
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if (d := int(key[a] ^ key[b])) in (0, 1, 2, 4, 8)}
    assert set(got) == want and len(got) == len(want)


def test_layout_of_groups():
    base, parts = layout(np.array([[3, 4, 50, 2, 2], [9, 9, 1, 0, 0]]), 10)
    assert parts.tolist() == [[1, 1, 5, 1, 1], [1, 1, 1, 1, 1]]
    assert base.tolist() == [[0, 0, 1, 16, 16], [17, 18, 18, 18, 18]]


def test_drawn_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [])], "vec_id long, embedding array<float>")
    out = {r.image_id: r.image for r in M.drawn(df).collect()}
    assert out[1] is not None and out[2] is None and out[3] is None and out[4] is None


def test_large_picture():
    big = np.kron(picture(9, M.SIDE), np.ones((12, 12), np.uint8))
    (corners, bits), = M.describe(big[None])
    assert len(corners) and bits.shape[1] == M.BITS // 8


def photo(seed, side=384):
    """A picture with detail at several sizes."""
    r = np.random.default_rng(seed)
    x = np.zeros((1, side, side), np.float32)
    for k in (1, 2, 4, 8):
        noise = r.normal(size=(1, side, side)).astype(np.float32)
        band = M._box(M._box(noise, k), k) - M._box(M._box(noise, 4 * k), k)
        x += band / band.std()
    return np.clip(128 + 25 * x[0], 0, 255).astype(np.uint8)


def shrunk(p, k):
    return p.reshape(p.shape[0] // k, k, p.shape[1] // k, k).mean((1, 3)).astype(np.uint8)


def test_recall_of_small_crops_and_scaled_copies():
    tried, found = {}, {}
    for s in range(5):
        p = photo(s)
        edited = {}
        for share in (0.1, 0.2, 0.3, 0.5):
            w = int(384 * share**0.5)
            y, x = np.random.default_rng(s).integers(0, 384 - w, 2)
            edited[share] = p[y : y + w, x : x + w]
        edited["pasted"] = photo(s + 50)
        edited["pasted"][100:260, 60:220] = p[150:310, 150:310]
        edited |= {f"1/{k}": shrunk(p, k) for k in (2, 4)}
        (whole,) = M.describe(p[None])
        for kind, q in edited.items():
            made = M.consensus(*whole, *M.describe(q[None])[0])
            tried[kind] = tried.get(kind, 0) + 1
            found[kind] = found.get(kind, 0) + bool(made and made[1] >= M.MIN_INLIERS)
        made = M.consensus(*whole, *M.describe(photo(s + 50)[None])[0])
        assert not made or made[1] < M.MIN_INLIERS
    assert all(found[k] >= 0.9 * tried[k] for k in tried), found


def test_corners_grow_with_area():
    p = photo(1)
    (small,), (large,) = M.describe(p[None, :192, :192]), M.describe(p[None])
    assert len(large[0]) > 3 * len(small[0])


def test_tables_meet_at_reach():
    r = np.random.default_rng(2)
    for descriptors in (10**5, 10**7, 10**9):  # longer keys, as many more tables
        length, cells, found = M.key_bits(descriptors), M.cell_bits(descriptors, M.TASK_ROWS), 0
        for _ in range(300):  # pairs of pictures with MIN_INLIERS matches, all at REACH
            a = r.integers(0, 2, (M.MIN_INLIERS, M.BITS), dtype=np.uint8)
            b = a.copy()
            for row in b:
                row[r.permutation(M.BITS)[: M.REACH]] ^= 1
            (x, p), (y, q) = (M.keys_of(np.packbits(v, axis=1), length, cells) for v in (a, b))
            apart = np.bitwise_count(x ^ y)
            meet = (apart == 0) | (apart == 1) & (x >> length - cells == y >> length - cells)
            meet &= np.bitwise_count(p ^ q) <= M.SKETCH_FAR
            found += meet.any(axis=1).sum() >= M.MIN_VOTES
        assert found >= 0.88 * 300, descriptors  # 0.91 is expected


def test_join_keeps_what_brute_force_finds_of_hard_copies(spark):
    r, pictures = np.random.default_rng(7), []
    for s in range(4):
        p = picture(s, M.SIDE)
        pictures.append(p)
        pictures += [np.clip(p + r.normal(scale=k, size=p.shape), 0, 255).astype(np.uint8) for k in (20, 35, 50)]
        pictures += [M._box(p[None].astype(np.float32), k)[0].astype(np.uint8) for k in (1, 2)]
        y, x = np.mgrid[: M.SIDE, : M.SIDE] - 47.5
        for turn, scale in ((0.2, 1), (0.5, 1), (0, 0.9), (0.3, 1.2)):
            u, v = np.cos(turn) * x - np.sin(turn) * y, np.sin(turn) * x + np.cos(turn) * y
            pictures.append(p[np.clip(np.round(v / scale + 47.5), 0, 95).astype(int), np.clip(np.round(u / scale + 47.5), 0, 95).astype(int)])
    described = [M.describe(p[None])[0] for p in pictures]
    brute = set()
    for a in range(len(pictures)):
        for b in range(a + 1, len(pictures)):
            made = M.consensus(*described[a], *described[b]) if len(described[a][0]) and len(described[b][0]) else None
            if made and made[1] >= M.MIN_INLIERS:
                brute.add((a, b))
    got = {(q.image_a, q.image_b) for q in M.copies(table(spark, [(i, M.encode(p)) for i, p in enumerate(pictures)])).collect()}
    print(len(got), len(brute))
    assert got <= brute and len(got) >= 0.9 * len(brute) and len(brute) >= 40
