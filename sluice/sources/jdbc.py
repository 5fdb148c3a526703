"""JDBC reader options from a ``connection_config`` row."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Mapping

log = logging.getLogger(__name__)


def parse_extra_options(text: str | None) -> dict[str, str]:
    """``extra_jdbc_options`` is a JSON object as text; anything else is ignored
    with a warning (seed data holds the text ``test``)."""
    if text is None or not str(text).strip():
        return {}
    try:
        value = json.loads(text)
    except json.JSONDecodeError:
        log.warning("extra_jdbc_options is not JSON, ignored: %r", text[:80])
        return {}
    if not isinstance(value, dict):
        log.warning("extra_jdbc_options is not a JSON object, ignored")
        return {}
    return {str(k): str(v) for k, v in value.items()}


def jdbc_options(conn: Mapping, table: str, secret: Callable[[str, str], str] | None = None,
                 fetchsize: int | None = None, partitioning: Mapping | None = None) -> dict[str, str]:
    """Options for ``spark.read.format('jdbc')``.

    The row names secret keys, not values; ``secret(scope, key)`` resolves
    them (a plain identity when the keys already hold the values, as in
    tests).  ``partitioning`` = ``{column, lowerBound, upperBound, numPartitions}``
    splits the read into parallel range queries, one per partition.
    """
    resolve = secret or (lambda scope, key: key)
    scope = conn.get("secret_scope")
    opts = {
        "url": resolve(scope, conn["jdbc_url_secret_key"]),
        "driver": conn["driver_class"],
        "dbtable": table,
    }
    user_key, pwd_key = conn.get("jdbc_user_secret_key"), conn.get("jdbc_password_secret_key")
    if user_key:
        opts["user"] = resolve(scope, user_key)
    if pwd_key:
        opts["password"] = resolve(scope, pwd_key)
    if fetchsize:
        opts["fetchsize"] = str(int(fetchsize))
    if partitioning:
        opts["partitionColumn"] = str(partitioning["column"])
        opts["lowerBound"] = str(partitioning["lowerBound"])
        opts["upperBound"] = str(partitioning["upperBound"])
        opts["numPartitions"] = str(int(partitioning["numPartitions"]))
    opts.update(parse_extra_options(conn.get("extra_jdbc_options")))
    return opts
