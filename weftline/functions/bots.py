"""The two bot rules; they differ on purpose and are never mixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_bot_sql(login: Column | str) -> Column:
    """Ends in ``[bot]`` whatever the case; null for a null login, so filters drop it either way."""
    return F.ilike(F.col(login) if isinstance(login, str) else login, F.lit("%[bot]"))


def is_bot_ui(login: Column | str) -> Column:
    """Ends in ``[bot]`` or ``-bot``, in that case; false for a null login."""
    c = F.col(login) if isinstance(login, str) else login
    return F.coalesce(c.endswith("[bot]") | c.endswith("-bot"), F.lit(False))
