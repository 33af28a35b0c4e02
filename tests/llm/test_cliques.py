"""Dense groups of near vectors, which meet as cliques, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from modlens.llm import vectors


def brute(ids, x, labels, least=0.98):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= least) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(links, False)
    root = np.array(ids)
    while True:
        new = np.minimum(root, np.where(links, root[None, :], root.max()).min(1))
        if (new == root).all():
            return links.sum(1), root
        root = new


@pytest.mark.parametrize("noise", [0.004, 0.009, 0.013])
def test_dense_groups(spark, noise):
    # of the last, about half of the pairs in a group are linked
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 64))
    centres[1] = centres[0] + rng.normal(size=64) * 0.12  # two groups side by side
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    near = np.concatenate([c + rng.normal(size=(150, 64)) * noise for c in centres])
    x = np.concatenate([near, near[:5], rng.normal(size=(300, 64))])
    ids, labels = rng.permutation(len(x)), np.where(np.arange(len(x)) % 11 == 0, 1, 0)
    rows = [(int(i), v.tolist(), int(n)) for i, v, n in zip(ids, x, labels)]
    got = {r["vec_id"]: r for r in vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    n_links, root = brute(ids, x, labels)
    found = np.array([got[int(i)]["n_links"] for i in ids])
    assert (found <= n_links).all() and found.sum() >= 0.9 * n_links.sum()
    if noise < 0.01:  # whole cliques: no link of theirs is lost
        assert (found == n_links).all() and [got[int(i)]["component_id"] for i in ids] == root.tolist()
