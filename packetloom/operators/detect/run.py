"""Running the detectors together."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.detect import bruteforce, ddos, portscan, synflood
from packetloom.operators.detect.common import Thresholds, folded
from packetloom.session import checkpoint_root

log = logging.getLogger(__name__)

Detector = Callable[[DataFrame, Thresholds], DataFrame]

# (name, priority, function); lower priority numbers run first.  Append own
# detectors in the same shape.
DETECTORS: tuple[tuple[str, int, Detector], ...] = (
    (ddos.NAME, ddos.PRIORITY, ddos.detect),
    (synflood.NAME, synflood.PRIORITY, synflood.detect),
    (portscan.NAME, portscan.PRIORITY, portscan.detect),
    (bruteforce.NAME, bruteforce.PRIORITY, bruteforce.detect),
)


def all_alerts(df: DataFrame, limits: Thresholds = Thresholds(),
               detectors: Sequence[tuple[str, int, Detector]] = DETECTORS,
               disabled: Sequence[str] = (), failed: list[str] | None = None) -> DataFrame:
    """Alerts of all enabled detectors.

    One that cannot be planned ends the run; with a ``failed`` list it is logged, named
    there and left out.  The packets are folded once for the library's own detectors, and
    written: one scan, and one shuffle of sums, feed all their rules (a second scan of one
    column feeds the growth rule where it is on).  Own detectors get the packets.
    """
    own = {detect for _, _, detect in DETECTORS}
    flows = None
    found = None
    for name, _, detect in sorted(detectors, key=lambda d: d[1]):
        if name in disabled:
            continue
        try:
            if detect in own:
                if flows is None:
                    checkpoint_root(df.sparkSession)
                    flows = folded(df).checkpoint()
                alerts = detect(flows, limits, **({"packets": df} if detect is ddos.detect else {}))
            else:
                alerts = detect(df, limits)
        except Exception:
            if failed is None:
                raise
            log.exception("detector %s failed", name)
            failed.append(name)
            continue
        found = alerts if found is None else found.unionByName(alerts)
    if found is None:
        raise ValueError("no detector could run")
    return found


def first_per_key(alerts: DataFrame) -> DataFrame:
    """Cooldown within one run: the first alert per (source, attack type).

    First means lowest priority number, then earliest packet.  An aggregate,
    not a window: each task keeps one candidate per key.
    """
    order = F.struct("priority", "first_packet", "destination_ip", F.coalesce("dst_port", F.lit(-1)))
    row = F.struct(*[F.col(c) for c in alerts.columns])
    return alerts.groupBy("source_ip", "attack_type").agg(F.min_by(row, order).alias("r")).select("r.*")


def run_detection(df: DataFrame, limits: Thresholds = Thresholds(), dedup: bool = True,
                  detectors: Sequence[tuple[str, int, Detector]] = DETECTORS,
                  disabled: Sequence[str] = (), failed: list[str] | None = None) -> DataFrame:
    alerts = all_alerts(df, limits, detectors, disabled, failed)
    return first_per_key(alerts) if dedup else alerts
