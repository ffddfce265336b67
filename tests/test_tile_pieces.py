"""Tiles keep to a bound of blocks, and their pairs are made piece by piece."""

import random

import numpy as np
import pytest

from weftline.operators import graph as G
from weftline.operators.tiles import met


def pairs_of(links, squares):
    want = {}
    for r, p, n in links:
        for q, o, m in links:
            if p == o and r < q:
                want[r, q] = want.get((r, q), 0) + (n * m if squares else 1)
    return want


@pytest.mark.parametrize("weighted", [False, True])
def test_links_are_shuffled_no_more_than_so_often(spark, monkeypatch, weighted):
    monkeypatch.setattr(G, "MOST", 4)
    rng = random.Random(2)
    links = [(r, p, rng.choice([-2, 1, 3, 40]) if weighted else 1) for p in ("hub", "a", "b", "c", "d") for r in range(80) if p == "hub" or rng.random() < 0.4]
    edges = G.counted_edges(spark.createDataFrame(links, "repo_id long, owner_login string, n long"), -10**6, block=1)
    assert edges.rdd.getNumPartitions() == 10  # pairs of 4 blocks; by the pairs there would be thousands
    assert {(e.src, e.dst): e.shared for e in edges.collect()} == {k: n for k, n in pairs_of(links, weighted).items() if n}


def test_more_links_than_a_task_holds_make_more_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "MOST", 2)
    monkeypatch.setattr(G, "LINKS", 10)
    links = [(r, p, 1) for p in ("x", "y") for r in range(30) if p == "x" or r % 3]
    edges = G.overlap_edges(spark.createDataFrame(links, "repo_id long, owner_login string, n long"), 2)
    assert edges.rdd.getNumPartitions() == 15  # 50 links are 5 blocks
    assert {(e.src, e.dst): e.shared for e in edges.collect()} == {k: n for k, n in pairs_of(links, False).items() if n >= 2}


@pytest.mark.parametrize("piece", [1, 7, 1000])
@pytest.mark.parametrize("later", [False, True])
def test_pieces_hold_whole_rows_and_every_pair(piece, later):
    rng = np.random.default_rng(4)
    row, code = np.sort(rng.integers(0, 20, 60)), rng.integers(0, 6, 60)
    codes, col = (code, row) if later else (rng.integers(0, 8, 40), rng.integers(0, 9, 40))
    width, order = col.max() + 1, np.argsort(codes * (col.max() + 1) + col)
    got, rows = [], []
    for start, end, counts, at in met(code, row, (codes * width + col)[order], width, row if later else None, piece):
        mine = np.repeat(np.arange(start, end), counts)
        got += zip(mine.tolist(), order[at].tolist(), strict=True)
        rows.append(set(row[start:end].tolist()))
        assert len(at) <= piece or len(rows[-1]) == 1
    assert sum(map(len, rows)) == len(set.union(*rows))
    want = [(i, j) for i in range(60) for j in range(len(col)) if code[i] == codes[j] and (not later or col[j] > row[i])]
    key = (lambda p: (row[p[0]], code[p[0]], col[p[1]])) if later else (lambda p: p)
    assert sorted(map(key, got)) == sorted(map(key, want))
