"""Recall with hundreds of cells and a dense group of different vectors."""

import numpy as np

from scopeloom.llm import embed_codes


def test_no_link_is_lost_in_a_hot_group_of_many_cells(spark):
    rng = np.random.default_rng(8)
    hot = rng.standard_normal(32)
    x = np.r_[hot / np.linalg.norm(hot) + 0.025 * rng.standard_normal((1500, 32)), rng.standard_normal((3000, 32))].astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    want = near.sum(1) - 1
    assert want[:1500].min() > 1000
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embed_codes.near_embeddings(table, cell_rows=20, block_rows=256).collect()}  # 225 cells
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.999 * want.sum()
    assert {got[i].component_id for i in range(1500)} == {0}
