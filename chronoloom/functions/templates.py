"""Online mining of log templates by a fixed-depth tree (He et al., ICWS 2017), in parallel and in stream order.

The miner's state changes only at a message that opens a group or turns a token into a
wildcard; all others just read it.  Those messages, with their row ids, are the log of
the miner's versions: the state at a row is what the logged messages before it have made.
So the log is all that has to be found in order:

1. every task mines its own rows from nothing and hands in the messages that changed its
   state, a few for each template;
2. these are played in stream order, and those that change the one shared state form a log;
3. every task plays the log up to each of its rows and looks for rows at which the state
   would change and that aren't logged (these are handed in), until there are none.

Before the first such row nothing can be wrong, and each round settles that row, so the
rounds end with the log of one miner over the whole stream, whatever the partitions.  Only
the log reaches the driver: its length follows the number of templates, not of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WILDCARD = "<*>"
Log = list[tuple[int, str]]


class TemplateMiner:
    """Groups messages by length and leading tokens, then by similarity; differing tokens become wildcards."""

    def __init__(self, depth: int = 4, similarity: float = 0.4, children: int = 100):
        self.prefix, self.similarity, self.children = depth - 2, similarity, children
        self.tree: dict = {}
        #: Token lists of all groups, in order of opening.
        self.groups: list[list[str]] = []

    def _leaf(self, tokens: list[str], grow: bool) -> list[int] | None:
        node = self.tree.setdefault(len(tokens), {}) if grow else self.tree.get(len(tokens))
        for token in tokens[: self.prefix]:
            if node is None:
                return None
            key = WILDCARD if any(c.isdigit() for c in token) else token
            if key not in node:
                full = len(node) >= self.children - (WILDCARD not in node)
                key = WILDCARD if full or (not grow and WILDCARD in node) else key
            node = node.setdefault(key, {}) if grow else node.get(key)
        if node is None:
            return None
        return node.setdefault("", []) if grow else node.get("")

    def _closest(self, leaf: list[int], tokens: list[str]) -> int | None:
        def likeness(group: int) -> tuple[float, int]:
            template = self.groups[group]
            same = sum(a == b for a, b in zip(template, tokens) if a != WILDCARD)
            return same / max(len(tokens), 1), template.count(WILDCARD)

        best = max(leaf, key=likeness, default=None)
        return best if best is not None and (likeness(best)[0] >= self.similarity or not tokens) else None

    def find(self, message: str) -> tuple[int | None, bool]:
        """(group, changes): the group that a message would go to now, None for a new one, and whether the state would change."""
        tokens = message.split()
        group = self._closest(self._routed(tokens) or [], tokens)
        return group, group is None or any(a != b and a != WILDCARD for a, b in zip(self.groups[group], tokens))

    def _routed(self, tokens: list[str]) -> list[int] | None:
        """The leaf that :meth:`add` would use, without making it."""
        node = self.tree.get(len(tokens))
        for token in tokens[: self.prefix]:
            if node is None:
                return None
            key = WILDCARD if any(c.isdigit() for c in token) else token
            if key not in node and len(node) >= self.children - (WILDCARD not in node):
                key = WILDCARD
            node = node.get(key)
        return None if node is None else node.get("")

    def take(self, message: str) -> tuple[int, bool]:
        """Take a message in: (its group, whether the state changed)."""
        group, changes = self.find(message)
        if changes:
            tokens = message.split()
            if group is None:
                group = len(self.groups)
                self.groups.append(list(tokens))
                self._leaf(tokens, grow=True).append(group)
            else:
                self.groups[group] = [a if a == b else WILDCARD for a, b in zip(self.groups[group], tokens)]
        return group, changes

    def template(self, group: int) -> str:
        """The template of a group as it is now."""
        return " ".join(self.groups[group])

    def add(self, message: str) -> str:
        """Take a message in; its template as known at this point."""
        return self.template(self.take(message)[0])

    def match(self, message: str) -> str | None:
        """The template of a message, changing nothing; None if no group fits."""
        tokens = message.split()
        group = self._closest(self._leaf(tokens, grow=False) or [], tokens)
        return None if group is None else self.template(group)

    def templates(self) -> list[str]:
        """All templates so far."""
        return sorted(map(" ".join, self.groups))


def played(entries: Log, miner: TemplateMiner | None = None) -> tuple[TemplateMiner, Log]:
    """A miner that has taken the entries in stream order, and those that changed it."""
    miner = miner or TemplateMiner()
    return miner, [(at, m) for at, m in sorted(entries) if miner.take(m)[1]]


class Replay:
    """A miner that follows a log of versions up to any row, rows ascending."""

    def __init__(self, log: Log):
        self.miner, self._log, self._next = TemplateMiner(), log, 0

    def upto(self, row_id: int) -> bool:
        """Play the log before a row; True if the row itself is the next entry."""
        log = self._log
        while self._next < len(log) and log[self._next][0] < row_id:
            self.miner.take(log[self._next][1])
            self._next += 1
        return self._next < len(log) and log[self._next][0] == row_id

    def skip(self) -> None:
        """The next entry was taken as a row."""
        self._next += 1


def _ordered(rows: DataFrame, order: str, message: str) -> DataFrame:
    return rows.select(F.col(order).cast("long").alias("at"), F.coalesce(message, F.lit("")).alias("m"))


def version_log(rows: DataFrame, *, message: str = "raw_message", order: str = "row_id") -> Log:
    """[(row id, message)] of the rows at which one miner over the whole stream changes its state.

    ``order`` is unique.  Tasks read their rows in order; no row is shuffled.
    """
    session, stream = rows.sparkSession, _ordered(rows, order, message).sortWithinPartitions("at")
    log: Log = []
    while True:
        shared = session.sparkContext.broadcast(log)

        def missing(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            replay = Replay(shared.value)  # noqa: B023
            for part in parts:
                found = []
                for at, m in zip(part["at"].tolist(), part["m"].tolist()):
                    logged = replay.upto(at)
                    changes = replay.miner.take(m)[1]  # what is missing is taken here, so that it is handed in once a task
                    if logged:
                        replay.skip()
                    elif changes:
                        found.append((at, m))
                yield pd.DataFrame(found, columns=["at", "m"])

        found = [tuple(r) for r in stream.mapInPandas(missing, "at long, m string").collect()]
        shared.unpersist()
        if not found:
            return log
        log = played([*log, *found])[1]


def mine_stream(rows: DataFrame, *, message: str = "raw_message", order: str = "row_id", log: Log | None = None) -> DataFrame:
    """``template_id``, ``event_template`` and ``final_template`` of every row, by one miner over the whole stream.

    ``event_template`` is its group's template as known at its line, ``final_template``
    as known at the end: that one fits every message of the group.  Other columns stay;
    a null message is an empty one.
    """
    log = version_log(rows, message=message, order=order) if log is None else log
    new = ["template_id", "event_template", "final_template"]
    kept = [c for c in rows.columns if c not in new]
    final = list(map(" ".join, played(log)[0].groups))
    shared = rows.sparkSession.sparkContext.broadcast((log, final))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(kept).schema) + ", template_id int, event_template string, final_template string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, final = shared.value
        replay = Replay(log)
        for part in parts:
            groups, known = [], []
            for at, m in zip(part[order].tolist(), part[message].tolist()):
                if replay.upto(at):
                    replay.skip()
                group = replay.miner.take(m or "")[0]
                groups.append(group)
                known.append(replay.miner.template(group))
            yield part.assign(template_id=pd.array(groups, "int32"), event_template=known, final_template=[final[g] for g in groups])

    return rows.select(kept).sortWithinPartitions(order).mapInPandas(run, schema)


def mine_online(rows: DataFrame, *, group: str = "source_file", message: str = "raw_message") -> DataFrame:
    """``event_template`` of every row, each as known at its line, where every group is a stream with a miner of its own.

    The state is a group's templates, and rows pass through in batches sorted within a
    partition, so that no group has to fit in memory.
    """
    kept = [c for c in rows.columns if c != "event_template"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(kept).schema) + ", event_template string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        miners: dict = {}
        for part in parts:
            found = [miners.setdefault(g, TemplateMiner()).add(m or "") for g, m in zip(part[group], part[message])]
            yield part.assign(event_template=found)

    return rows.select(kept).repartition(group).sortWithinPartitions(group, "row_id").mapInPandas(run, schema)


def train_templates(rows: DataFrame, *, message: str = "raw_message", order: str = "row_id") -> TemplateMiner:
    """A miner that has met every message of the stream, in its order, however the rows are dealt."""
    return played(version_log(rows, message=message, order=order))[0]


def assign_templates(rows: DataFrame, miner: TemplateMiner, *, message: str = "raw_message") -> DataFrame:
    """``event_template`` by a trained miner, for rows of any kind; a message that fits none is its own template."""
    shared = rows.sparkSession.sparkContext.broadcast(miner)

    @F.pandas_udf("string")
    def match(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shared.value.match(t or "") or t or "")

    return rows.withColumn("event_template", match(message))
