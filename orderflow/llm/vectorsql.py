"""SQL for the vector operators whose arithmetic is whole numbers."""

from __future__ import annotations


def part_codes(positions: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Codes by product quantisation; distances as |x|^2 + |e|^2 - 2 x e, whole numbers in doubles."""
    nearest = """
{to} AS MATERIALIZED (
    SELECT row, vec_id, label, position, part, arg_min(entry, far * {entries} + entry) AS entry, min(far) AS far
    FROM (SELECT p.row, p.vec_id, p.label, p.position, p.part, b.entry,
                 p.norm + list_inner_product(b.cells, b.cells) - 2 * list_inner_product(p.part, b.cells) AS far
          FROM parts p JOIN {book} b ON p.position = b.position)
    GROUP BY row, vec_id, label, position, part
)"""
    renewed = """
{to} AS MATERIALIZED (
    SELECT b.position, b.entry, coalesce(m.cells, b.cells) AS cells
    FROM {book} b LEFT JOIN (
        SELECT position, entry, list(mean ORDER BY i) AS cells
        FROM (SELECT position, entry, i,
                     ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::DOUBLE AS mean
              FROM (SELECT position, entry, unnest(range(1, len(part) + 1)) AS i,
                           unnest(list_transform(part, lambda x: x::BIGINT)) AS v FROM {near})
              GROUP BY position, entry, i)
        GROUP BY position, entry
    ) m ON b.position = m.position AND b.entry = m.entry
)"""
    steps = [
        f"""
whole AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, label,
           list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS cells
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS (
    SELECT row, vec_id, label, cells, unnest(range(0, {positions})) AS position, len(cells) // {positions} AS width
    FROM whole
), parts AS MATERIALIZED (
    SELECT row, vec_id, label, position, part, list_inner_product(part, part) AS norm
    FROM (SELECT row, vec_id, label, position,
                 list_slice(cells, position * width + 1, (position + 1) * width) AS part FROM cut)
), book0 AS (
    SELECT position, row_number() OVER (PARTITION BY position ORDER BY vec_id) - 1 AS entry, part AS cells
    FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY vec_id) AS place FROM parts)
    WHERE place <= {entries}
)"""
    ]
    for n in range(rounds):
        steps.append(nearest.format(to=f"near{n}", book=f"book{n}", entries=entries))
        steps.append(renewed.format(to=f"book{n + 1}", book=f"book{n}", near=f"near{n}"))
    steps.append(nearest.format(to="final", book=f"book{rounds}", entries=entries))
    steps.append(f"""
digest AS (
    SELECT sha256(string_agg(array_to_string(list_transform(cells, lambda x: x::BIGINT::VARCHAR), ','), ','
                             ORDER BY position, entry)) AS codebooks_sha256 FROM book{rounds}
), coded AS (
    SELECT row, vec_id, label, string_agg(right('0' || lower(to_hex(entry)), 2), '' ORDER BY position) AS code,
           sum(far)::BIGINT AS error
    FROM final GROUP BY row, vec_id, label
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded, digest""")
    ctes, last = steps[:-1], steps[-1]
    return "WITH" + ",".join(ctes) + "," + last


def clusters(count: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256) -> str:
    """Centroid clustering from hashed first centroids, all of it in whole numbers."""
    nearest = """
{to} AS MATERIALIZED (
    SELECT row, vec_id, cells, arg_min(cluster, far * {count} + cluster) AS cluster, min(far) AS far
    FROM (SELECT w.row, w.vec_id, w.cells, c.cluster,
                 w.norm + list_inner_product(c.cells, c.cells) - 2 * list_inner_product(w.cells, c.cells) AS far
          FROM whole w, {book} c)
    GROUP BY row, vec_id, cells
)"""
    renewed = """
{to} AS MATERIALIZED (
    SELECT b.cluster, coalesce(m.cells, b.cells) AS cells
    FROM {book} b LEFT JOIN (
        SELECT cluster, list(mean ORDER BY i) AS cells
        FROM (SELECT cluster, i,
                     ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::DOUBLE AS mean
              FROM (SELECT cluster, unnest(range(1, len(cells) + 1)) AS i,
                           unnest(list_transform(cells, lambda x: x::BIGINT)) AS v FROM {near})
              GROUP BY cluster, i)
        GROUP BY cluster
    ) m ON b.cluster = m.cluster
)"""
    steps = [
        f"""
whole AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, cells, list_inner_product(cells, cells) AS norm
    FROM (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS cells
          FROM embeddings
          WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), book0 AS (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, cells
    FROM whole QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id)) <= {count}
)"""
    ]
    for n in range(rounds):
        steps.append(nearest.format(to=f"near{n}", book=f"book{n}", count=count))
        steps.append(renewed.format(to=f"book{n + 1}", book=f"book{n}", near=f"near{n}"))
    steps.append(nearest.format(to="final", book=f"book{rounds}", count=count))
    return "WITH" + ",".join(steps) + f"""
SELECT f.vec_id, f.cluster::INTEGER AS cluster, f.far::BIGINT AS distance,
       sum(f.far) OVER (PARTITION BY f.cluster)::BIGINT AS cluster_inertia, sum(f.far) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(list_transform(b.cells, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM final f JOIN book{rounds} b ON f.cluster = b.cluster"""
