"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

# the sixteen steps of CRC-32 by half bytes, polynomial EDB88320
CRC_STEPS = """
    SELECT list(v ORDER BY n) AS steps FROM (
        SELECT n, list_reduce([n::UBIGINT] || [0::UBIGINT, 0, 0, 0],
            lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
        FROM range(16) t(n))
"""

SHARDING = f"""
WITH crc AS ({CRC_STEPS}),
digits AS (
    SELECT doc_id, coalesce(text, '') AS body, string_split(hex(encode(coalesce(text, ''))), '') AS h, strlen(coalesce(text, '')) + 1 AS size
    FROM documents),
base AS (
    SELECT doc_id, size, md5(body) AS g,
        CASE WHEN size = 1 THEN 0 ELSE xor(list_reduce([4294967295::UBIGINT] || list_transform(range(len(h)),
            lambda i: (instr('0123456789ABCDEF', h[xor(i, 1) + 1]) - 1)::UBIGINT),
            lambda c, d: xor(c >> 4, steps[(xor(c, d) & 15)::BIGINT + 1])), 4294967295::UBIGINT) END::BIGINT AS text_crc32
    FROM digits, crc),
placed AS (
    SELECT *, sum(size) OVER (ORDER BY g, doc_id ROWS UNBOUNDED PRECEDING) - size AS first,
        row_number() OVER (ORDER BY g, doc_id) - 1 AS idx, (sum(size) OVER ()) / 16.0::DOUBLE AS target FROM base),
targets AS (SELECT k, k * target AS pos, target FROM range(1, 16) t(k), (SELECT any_value(target) AS target FROM placed)),
groups AS (SELECT g, min(first) AS low, max(first + size) AS high, max(size) AS one FROM placed GROUP BY g),
across AS (
    SELECT k, pos, low + CASE WHEN high - low > greatest(0.01 * target, one) THEN floor((pos - low) / one) * one ELSE 0 END AS low,
        CASE WHEN high - low > greatest(0.01 * target, one) THEN low + (floor((pos - low) / one) + 1) * one ELSE high END AS high
    FROM targets LEFT JOIN groups ON low < pos AND pos < high),
cuts AS (SELECT CASE WHEN low IS NULL THEN pos WHEN pos - low <= high - pos THEN low ELSE high END AS cut FROM across),
sharded AS (SELECT *, (SELECT count(*) FROM cuts WHERE cut <= first)::INT AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
    (idx - min(idx) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM sharded
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WINNOWING = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM items),
item_windows AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
doc_windows AS (SELECT doc_id, n, i, w[i:i + n - 1] AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths)),
hits AS (SELECT doc_id, item_id, i, n FROM doc_windows JOIN item_windows USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

MIXING = r"""
WITH d AS (
    SELECT doc_id, source, md5(coalesce(text, '')) AS digest, md5('7:' || coalesce(doc_id::VARCHAR, '')) AS place,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
    FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
weighed AS (
    SELECT source, source_size, 2.0 * source_size::DOUBLE AS most, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
    FROM sized),
filled AS (
    SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS words, (sum(weight) OVER ())::DOUBLE AS all_weights,
        coalesce(sum(most) OVER before, 0)::DOUBLE AS spent, coalesce(sum(weight) OVER before, 0)::DOUBLE AS gone
    FROM weighed WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max((words - spent) / (all_weights - gone)) AS height FROM filled),
targets AS (SELECT source, source_size, least(weight * height, most) AS target, floor(least(weight * height, most) + 0.5)::BIGINT AS goal FROM filled, level),
lines AS (
    SELECT d.*, source_size, target, goal,
        (sum(size) OVER (PARTITION BY d.source ORDER BY place, size, digest ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
    FROM d JOIN targets ON d.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
    (greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - source_size - start)))::BIGINT AS taken
FROM lines
"""

AUDIT = r"""
WITH marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY body) THEN 'E' ELSE '' END AS failed
    FROM d LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
    SELECT a.c || b.c || x.c || y.c || z.c AS filter_order FROM letters a, letters b, letters x, letters y, letters z
    WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
steps AS (SELECT filter_order, step::INT AS step, filter_order[step] AS letter, filter_order[:step - 1] AS before FROM orders, range(1, 6) t(step)),
met AS (
    SELECT *, contains(failed, letter) AS fails, length(translate(failed, before, '')) < length(failed) AS gone
    FROM cells, steps),
counted AS (
    SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
        coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (failed = letter), 0) AS unique_fails,
        coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost
    FROM met GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
"""

ORACLES: dict[str, str] = {"op9_winnowing": WINNOWING, "op1_sharding": SHARDING, "op11_mixing": MIXING, "op13_filter_audit": AUDIT}
