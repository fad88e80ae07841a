"""Who may read a memory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """A reader: an agent, and maybe a user and a session of it."""

    agent: str
    user: str | None = None
    session: str | None = None

    def can_read(self, agent: Column | str = "agent", user: Column | str = "user", session: Column | str = "session", shared: Column | str = "shared_with") -> Column:
        """Other agents' memories if shared with this one; the own agent's if user and session, as far as they are set, agree."""
        agent, user, session, shared = (F.col(c) if isinstance(c, str) else c for c in (agent, user, session, shared))
        same_user = user.isNull() | (F.coalesce(user == F.lit(self.user), F.lit(False)) & (session.isNull() | F.coalesce(session == F.lit(self.session), F.lit(False))))
        return F.when(agent != self.agent, F.coalesce(F.array_contains(shared, self.agent), F.lit(False))).otherwise(same_user)


    def share_with(self, agents) -> dict:
        """Fields of a memory in this scope that the agents may read too, each named once."""
        return {"scope": self, "shared_with": list(dict.fromkeys(agents))}


def row_can_read(reader: dict[str, Column], agent: Column, user: Column, session: Column, shared: Column) -> Column:
    """The same for a reader that is a row itself: columns agent, user and session."""
    same_user = user.isNull() | (F.coalesce(user == reader["user"], F.lit(False)) & (session.isNull() | F.coalesce(session == reader["session"], F.lit(False))))
    return F.when(agent != reader["agent"], F.coalesce(F.array_contains(shared, reader["agent"]), F.lit(False))).otherwise(same_user)


def to_key(agent: Column, user: Column, session: Column, shared: Column) -> Column:
    return F.concat_ws("|", agent, F.coalesce(user, F.lit("")), F.coalesce(session, F.lit("")), F.when(F.size(shared) > 0, F.array_join(shared, ",")))


def from_key(key: Column) -> Column:
    """A struct of agent, user, session and shared_with; null for keys of fewer than three parts."""
    parts = F.split(key, r"\|", 4)
    empty = lambda c: F.when(c != "", c)
    shared = F.filter(F.split(F.coalesce(F.get(parts, F.lit(3)), F.lit("")), ","), lambda s: s != "")
    return F.when(F.size(parts) >= 3, F.struct(F.get(parts, F.lit(0)).alias("agent"), empty(F.get(parts, F.lit(1))).alias("user"), empty(F.get(parts, F.lit(2))).alias("session"), shared.alias("shared_with")))
