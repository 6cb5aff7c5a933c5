"""Workers that take, process, checkpoint, hand over, crash and wake up late: what must hold in every state.

The model has a parent shard and a child, the lease store as it is, and workers whose view of a lease may be stale.
"""

from hypothesis import settings
from hypothesis import strategies as st
from hypothesis.stateful import RuleBasedStateMachine, invariant, precondition, rule

from millrace.operators.leases import LeaseStore

LOG = {"parent": ["1", "2", "3"], "child": ["4", "5"]}
WORKERS = st.sampled_from(["a", "b", "c"])
SHARDS = st.sampled_from(sorted(LOG))


class Fleet(RuleBasedStateMachine):
    def __init__(self):
        super().__init__()
        self.store = LeaseStore()
        for shard in LOG:
            self.store.run(shard, "create", parents=["parent"] if shard == "child" else [])
        #: What a worker believes: (worker, shard) to [counter, place in the log].
        self.views: dict[tuple[str, str], list[int]] = {}
        self.delivered: list[tuple[str, str, str]] = []
        self.counters = dict.fromkeys(LOG, 0)
        self.crashes = 0

    def place(self, shard):
        checkpoint = self.store.get(shard).checkpoint
        return LOG[shard].index(checkpoint) + 1 if checkpoint else 0

    @rule(w=WORKERS, shard=SHARDS, expired=st.booleans())
    def take(self, w, shard, expired):
        """A free lease, or one whose owner has shown no sign of life; a child only after its parent."""
        row = self.store.get(shard)
        if row.completed or (row.owner not in (None, w) and not expired) or (shard == "child" and not self.store.get("parent").completed):
            return
        now, ok = self.store.run(shard, "claim", w, row.counter)
        assert ok and now.owner == w
        self.views[w, shard] = [now.counter, self.place(shard)]

    @precondition(lambda self: self.views)
    @rule(data=st.data())
    def process(self, data):
        """Deliver the next record by what the worker believes, which another worker may have made untrue."""
        w, shard = data.draw(st.sampled_from(sorted(self.views)))
        view = self.views[w, shard]
        if view[1] < len(LOG[shard]):
            self.delivered.append((w, shard, LOG[shard][view[1]]))
            view[1] += 1

    @precondition(lambda self: self.views)
    @rule(data=st.data(), op=st.sampled_from(["renew", "checkpoint", "complete", "release"]))
    def write(self, data, op):
        w, shard = data.draw(st.sampled_from(sorted(self.views)))
        view, before = self.views[w, shard], self.store.get(shard)
        if op == "checkpoint" and not view[1] or op == "complete" and self.place(shard) < len(LOG[shard]):
            return
        after, ok = self.store.run(shard, op, w, view[0], LOG[shard][view[1] - 1] if op == "checkpoint" else None)
        # A write succeeds for the owner that saw the last one, and for nobody else; a refused one changes nothing.
        assert ok == (before.owner == w and before.counter == view[0]) and (ok or after == before)
        if not ok or op in ("release", "complete"):
            del self.views[w, shard]
        else:
            view[0] = after.counter

    @rule(w=WORKERS)
    def crash(self, w):
        self.crashes += 1
        self.views = {k: v for k, v in self.views.items() if k[0] != w}

    @invariant()
    def counters_never_go_back(self):
        for shard in LOG:
            now = self.store.get(shard).counter
            assert now >= self.counters[shard]
            self.counters[shard] = now

    @invariant()
    def one_holder(self):
        for shard in LOG:
            row = self.store.get(shard)
            assert sum(s == shard and w == row.owner and v[0] == row.counter for (w, s), v in self.views.items()) <= 1

    @invariant()
    def nothing_is_skipped_and_order_holds(self):
        for shard in LOG:
            first = list(dict.fromkeys(seq for _, s, seq in self.delivered if s == shard))
            assert first == LOG[shard][: len(first)]
            checkpoint = self.store.get(shard).checkpoint
            assert checkpoint is None or checkpoint in first

    @invariant()
    def parents_come_first(self):
        shards = [s for _, s, _ in self.delivered]
        if "child" in shards:
            assert {q for _, s, q in self.delivered[: shards.index("child")] if s == "parent"} == set(LOG["parent"])

    def teardown(self):
        """Whatever has happened: one worker that lives on delivers all that was not acknowledged."""
        for shard in ("parent", "child"):
            row = self.store.get(shard)
            if not row.completed:
                row, _ = self.store.run(shard, "claim", "last", row.counter)
                for k in range(self.place(shard), len(LOG[shard])):
                    self.delivered.append(("last", shard, LOG[shard][k]))
                row, ok = self.store.run(shard, "checkpoint", "last", row.counter, LOG[shard][-1])
                assert ok and self.store.run(shard, "complete", "last", row.counter)[1]
            assert {q for _, s, q in self.delivered if s == shard} == set(LOG[shard])


Fleet.TestCase.settings = settings(max_examples=150, stateful_step_count=40, deadline=None)
TestFleet = Fleet.TestCase
