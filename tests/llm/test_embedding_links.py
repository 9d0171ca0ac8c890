"""Links near the threshold, large groups of copies, and the registered SQL on tables that hold links."""

import duckdb
import numpy as np

from tidewater.llm import embeddings


def near(rng, x, cosine):
    """A vector of the given cosine to x."""
    y = rng.standard_normal(len(x))
    y -= y @ x / (x @ x) * x
    return cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine * cosine) * y / np.linalg.norm(y)


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows], "vec_id bigint, embedding array<double>")


def test_planted_pairs_just_above_the_threshold(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(1500):
        x = rng.standard_normal(48)
        rows += [(2 * k, x), (2 * k + 1, near(rng, x, 0.95 + 0.01 * (k % 100 + 1) / 100))]
    got = embeddings.near_duplicates(frame(spark, rows)).filter("n_links = 1 AND component_id = vec_id - vec_id % 2").count()
    assert got >= 0.99 * len(rows)
    below = [(2 * k + j, x if j else near(rng, x, 0.9499)) for k in range(200) for x in [rng.standard_normal(48)] for j in (0, 1)]
    assert embeddings.near_duplicates(frame(spark, below)).filter("n_links > 0").count() == 0


def test_copies_are_one_class(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal(16)
    rows = [(i, x) for i in range(20000)] + [(30000 + i, near(rng, x, 0.99)) for i in range(3)] + [(40000 + i, rng.standard_normal(16)) for i in range(500)]
    r = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(frame(spark, rows)).collect()}
    u = np.array([v / np.linalg.norm(v) for _, v in rows[20000:20003]])
    own = ((u @ u.T) >= 0.95).sum(1) - 1
    assert all(r[i] == (20002, 0) for i in range(20000)) and [r[30000 + i] for i in range(3)] == [(20000 + int(n), 0) for n in own]
    assert all(r[40000 + i] == (0, 40000 + i) for i in range(500) if (x / np.linalg.norm(x)) @ (rows[20003 + i][1] / np.linalg.norm(rows[20003 + i][1])) < 0.9)


def test_the_sql_on_tables_with_links(spark, tmp_path):
    rng = np.random.default_rng(13)
    centres = rng.standard_normal((30, 24))
    rows = [(i, centres[i % 30] + 0.12 * rng.standard_normal(24)) for i in range(300)] + [(400 + i, centres[0]) for i in range(5)] + [(500, np.zeros(24))]
    df = frame(spark, rows)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    cur = c.execute(embeddings.ORACLE)
    names = [x[0] for x in cur.description]
    want = sorted(cur.fetchall())
    got = sorted(tuple(r) for r in embeddings.op8_embeddings(spark, str(tmp_path)).select(*names).collect())
    assert sum(r[names.index("n_links")] for r in want) > 500 and got == want


def test_codes_estimate_without_bias():
    rng = np.random.default_rng(14)
    dim, p = 64, embeddings.rotation(64, 3)
    errors, inside = [], []
    for cosine in (0.0, 0.5, 0.95):
        x = rng.standard_normal((2000, dim))
        x /= np.linalg.norm(x, axis=1)[:, None]
        y = np.array([near(rng, v, cosine) for v in x])
        q, f, step = embeddings.codes(x, p)
        r, _, other = embeddings.codes(y, p)
        assert (np.abs((r + 0.5) * other[:, None] - y @ p) <= other[:, None] * 0.5000001).all()
        est = (np.where(q >= 0, 1.0, -1.0) * (r + 0.5) * other[:, None]).sum(1) / (np.sqrt(dim) * f)
        errors.append(est.mean() - cosine)
        bound = embeddings.CONFIDENCE * np.sqrt(1 - f * f) / (f * np.sqrt(dim - 1)) + other * np.sqrt(dim) / (2 * f)
        inside.append((np.abs(est - cosine) <= bound).mean())
    assert max(map(abs, errors)) < 0.01 and min(inside) > 0.999
