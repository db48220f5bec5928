"""The jobs as queries: each runs its job twice into one new folder, and returns all that is there afterwards."""

from __future__ import annotations

import json
from pathlib import Path

from canloom.functions.shared import new_folder
from canloom.plans import frame_view as view
from canloom.plans import queries as q
from canloom.plans.registry import query
from jobs import bus_archive, text_payloads


def config(job) -> dict:
    """The config file beside a job."""
    return json.loads(Path(job.__file__).with_suffix(".json").read_text())


# the view's frames by day: times count from midnight
_DAYS = view.FRAMES_SQL.strip().replace("((us - t0) // 4320)", "((us % 86400000000) // 4320)")
_LOGS = "logs AS (SELECT f.*, CAST(DATE '1970-01-01' + CAST(us // 86400000000 AS INTEGER) AS VARCHAR) AS file FROM frames f JOIN e ON event_id = f.seq)"

ARCHIVE_SQL = "WITH " + ",\n".join([_DAYS, q._SIGNAL_VALUES, _LOGS, *q._FLEET[1:], "known AS (SELECT f.file, c.* FROM logs f JOIN classified c ON c.seq = f.seq)",
    "groups AS (SELECT file, channel, arb_norm, message_name, count(*) AS n_frames, min(seq) AS first_seq FROM known WHERE valid GROUP BY ALL)",
    "n AS (SELECT file, channel, count(*) FILTER (WHERE valid) AS decoded, count(*) FILTER (WHERE NOT valid) AS unknown, count(DISTINCT CASE WHEN NOT valid THEN arb_id END) AS ids FROM known GROUP BY ALL)",
    "s AS (SELECT file, channel, CAST(sum(n_signals) AS BIGINT) AS n FROM (SELECT DISTINCT file, channel, dbc, arb_norm FROM known WHERE valid) d JOIN messages m ON m.dbc = d.dbc AND m.arb_norm = d.arb_norm GROUP BY ALL)",
    "summed AS (SELECT l.file, b.channel, coalesce(decoded, 0) AS decoded, coalesce(unknown, 0) AS unknown, coalesce(ids, 0) AS ids, coalesce(s.n, 0) AS signals FROM (SELECT DISTINCT file FROM logs) l CROSS JOIN bound b LEFT JOIN n ON n.file = l.file AND n.channel = b.channel LEFT JOIN s ON s.file = l.file AND s.channel = b.channel)"]) + """
SELECT l.file AS day, 'sample' AS kind, s.channel, message_name || '.' || signal_name AS name, CAST(s.seq AS BIGINT) AS place, phys AS value FROM long s JOIN logs l ON l.seq = s.seq
UNION ALL SELECT file, 'count', channel, class, k, CAST(count AS DOUBLE) FROM dense
UNION ALL SELECT file, 'rate', channel, class, k, CASE WHEN k = last THEN coalesce(lag(rate) OVER (PARTITION BY file, channel, class ORDER BY k), 0e0) ELSE rate END FROM dense
UNION ALL SELECT file, 'group', channel, message_name, row_number() OVER (PARTITION BY file, channel ORDER BY first_seq), CAST(n_frames AS DOUBLE) FROM groups
UNION ALL SELECT file, 'summary', channel, 'decoded', signals, CAST(decoded AS DOUBLE) FROM summed
UNION ALL SELECT file, 'summary', channel, 'unknown', ids, CAST(unknown AS DOUBLE) FROM summed
"""  # fmt: skip


@query("job1_bus_archive", ARCHIVE_SQL)
def job1_bus_archive(spark, sf_dir):
    out, settings = new_folder(spark, "job1"), config(bus_archive)
    for _ in range(2):
        bus_archive.run(spark, f"{sf_dir}/events.parquet", out, settings)
    return bus_archive.whole(spark, out)


PAYLOADS_SQL = """
WITH t AS (SELECT doc_id, coalesce(((doc_id % 12) + 12) % 12, 0)::INTEGER AS channel, CASE lang WHEN 'en' THEN 1792 WHEN 'de' THEN 1793 WHEN 'fr' THEN 1794 WHEN 'es' THEN 1795 ELSE 1808 END AS id,
    encode(rtrim(coalesce(text, ''), chr(0))) AS b FROM documents),
f AS (SELECT doc_id, channel, id, part, b[1 + 64 * part : 64 + 64 * part] AS data FROM (SELECT *, CAST(unnest(range(0, CAST(ceil(octet_length(b) / 64.0) AS BIGINT))) AS INTEGER) AS part FROM t WHERE id <= 1794)),
w AS (SELECT channel, max(octet_length(data)) AS width FROM f GROUP BY channel)
SELECT doc_id, f.channel, CAST(id AS BIGINT) AS id, part, 'Raw::CAN' || f.channel AS group_name, CAST(octet_length(data) AS BIGINT) AS size, rpad(lower(hex(data)), CAST(2 * width AS INTEGER), '0') AS content, CAST(NULL AS BOOLEAN) AS exported FROM f JOIN w ON w.channel = f.channel
UNION ALL SELECT doc_id, channel, CAST(id AS BIGINT), NULL, NULL, CAST(octet_length(b) AS BIGINT), sha256(b), octet_length(b) > 0 AND id <= 1794 FROM t
"""


@query("job2_text_payloads", PAYLOADS_SQL)
def job2_text_payloads(spark, sf_dir):
    out, settings = new_folder(spark, "job2"), config(text_payloads)
    for _ in range(2):
        text_payloads.run(spark, f"{sf_dir}/documents.parquet", out, settings)
    return text_payloads.whole(spark, out)
