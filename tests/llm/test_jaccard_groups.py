"""Large groups of near copies, alone and beside documents that nearly belong to them."""

import random

import pytest

from keyloom.llm import jaccard


def components_by_hand(rows):
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def group(seed, base, n, edits):
    """n texts, each with some of the base's words replaced."""
    r, out = random.Random(seed), []
    for _ in range(n):
        w = list(base)
        for _ in range(r.choice(edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def texts():
    base = [f"b{i}" for i in range(120)]
    out = group(1, base, 150, [1, 2])  # most link with one another
    out += group(2, base, 40, [3, 4, 5, 6])  # some link with some
    out += group(3, [*base[:70], *(f"o{i}" for i in range(50))], 60, [0, 1, 2])  # links with none of these, but shares shingles
    out += group(4, [f"x{i}" for i in range(30)], 30, [0, 1])
    rows = list(enumerate(dict.fromkeys(out)))
    random.Random(5).shuffle(rows)
    return rows


@pytest.mark.parametrize("region, leaf, text", [(40, 4, 0), (12, 2, 10**9)])
def test_groups_of_near_copies(spark, monkeypatch, region, leaf, text):
    for name, value in (("REGION", region), ("LEAF", leaf), ("TEXT", text)):
        monkeypatch.setattr(jaccard, name, value)
    rows = texts()
    got = {r.doc_id: r.component_id for r in jaccard.components_of(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == components_by_hand(rows)


def test_links_do_not_grow_with_regions(spark, monkeypatch):
    """A document is in a region for every shingle of its prefix; links were made in each of them."""
    made, links = [], jaccard.links

    def counted(*args):
        out = links(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "links", counted)
    rows = list(enumerate(group(7, [f"b{i}" for i in range(200)], 300, [1, 2, 3])))
    jaccard.components_of(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert 0 < made[0] <= 2 * len(rows)


def test_frequent_shingles_are_counted_in_all_documents(spark):
    """A sample of one document in sixteen missed a line of four, and took what it saw in three for frequent."""
    line = "one line that some of the texts have"
    rows = [(i, f"{line if i % 50 == 0 else ''} a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(200)] + [(1000 + i, f"{line} a0 b0 c0 d0 e0 f0") for i in range(9)]
    often, most = jaccard.classes(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1))[1]
    flat, _ = jaccard.sets([line.encode()])
    assert sorted(often) == sorted(flat) and sorted(most) == sorted(flat)
