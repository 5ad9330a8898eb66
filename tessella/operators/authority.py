"""Reservations of unique keys and leases of values.

This is bookkeeping of single operations, not of data: it lies in one versioned
document of each index, and writers that meet retry. Operations are idempotent by their 16-byte id.
"""

from __future__ import annotations

from dataclasses import dataclass

from tessella.errors import Busy, FailedPrecondition, InvalidArgument, UniqueViolation
from tessella.sources.files import State

MAX_LEASE = 65_536
#: ended reservations that the document keeps, so that their operations may ask again
MAX_ENDED = 256


@dataclass(frozen=True)
class Lease:
    first: int
    last: int
    state: str


class Authority:
    def __init__(self, engine, index: str) -> None:
        self.engine = engine
        self.at = State(engine.store.files, f"{engine.store.root}/authority/{index}")

    def _change(self, how):
        for _ in range(20):
            version, x = self.at.read({"reservations": {}, "leases": {}, "next": {}})
            out, changed = how(x)
            if not changed:
                return out
            try:
                self.at.write(version, x)
                return out
            except Busy:
                continue
        raise Busy("the index is in demand")

    @staticmethod
    def _id(operation: bytes) -> str:
        if len(operation) != 16:
            raise InvalidArgument("an operation's id has 16 bytes")
        return operation.hex()

    # -- reservations
    def reserve(self, operation: bytes, keys: bytes | list[bytes], shard: int, old_key: bytes | None = None) -> str:
        """Claims keys for a write that is under way, all or none; the same operation may ask again."""
        name, wanted = self._id(operation), sorted(k.hex() for k in ([keys] if isinstance(keys, bytes) else keys))

        def how(x):
            own = x["reservations"].get(name)
            want = {"keys": wanted, "shard": shard, "old": old_key.hex() if old_key else None, "state": "pending"}
            if own:
                if {k: own[k] for k in ("keys", "shard", "old")} != {k: want[k] for k in ("keys", "shard", "old")}:
                    raise InvalidArgument("the operation's id was used for another reservation")
                return own["state"], False
            taken = {k for r in x["reservations"].values() if r["state"] == "pending" for k in r["keys"]}
            if taken & set(wanted):
                raise UniqueViolation("the key is reserved")
            # what ended long ago answers no one any more
            ended = [n for n, r in x["reservations"].items() if r["state"] != "pending"]
            for n in ended[: max(0, len(ended) - MAX_ENDED)]:
                del x["reservations"][n]
            x["reservations"][name] = want
            return "pending", True

        return self._change(how)

    def _end(self, operation: bytes, to: str) -> str:
        name = self._id(operation)

        def how(x):
            own = x["reservations"].get(name)
            if own is None:
                raise InvalidArgument("the reservation is not known")
            if own["state"] == to:
                return to, False
            if own["state"] != "pending":
                raise FailedPrecondition("the reservation has ended otherwise")
            own["state"] = to
            return to, True

        return self._change(how)

    def finalize(self, operation: bytes) -> str:
        return self._end(operation, "finalized")

    def rollback(self, operation: bytes) -> str:
        return self._end(operation, "rolled_back")

    def shards(self, keys: list[bytes]) -> list[int]:
        """Shards of pending reservations of the keys, on either side of a change."""
        want = {k.hex() for k in keys}
        _, x = self.at.read({"reservations": {}})
        return sorted({r["shard"] for r in x["reservations"].values() if r["state"] == "pending" and (want & set(r["keys"]) or r["old"] in want)})

    # -- value leases
    def lease(self, operation: bytes, sequence: str, count: int) -> Lease:
        """A range of values that no other lease of the sequence has or will have."""
        if not 1 <= count <= MAX_LEASE:
            raise InvalidArgument(f"a lease holds 1 to {MAX_LEASE} values")
        name = self._id(operation)

        def how(x):
            own = x["leases"].get(name)
            if own:
                if own["sequence"] != sequence or own["last"] - own["first"] + 1 != count:
                    raise InvalidArgument("the operation's id was used for another lease")
                return Lease(own["first"], own["last"], own["state"]), False
            first = x["next"].get(sequence, 1)
            x["next"][sequence] = first + count
            x["leases"][name] = {"sequence": sequence, "first": first, "last": first + count - 1, "state": "leased"}
            return Lease(first, first + count - 1, "leased"), True

        return self._change(how)

    def transition(self, operation: bytes, to: str) -> Lease:
        """leased -> consumed or abandoned; values of an abandoned lease are not used again."""
        if to not in ("consumed", "abandoned"):
            raise InvalidArgument("a lease becomes consumed or abandoned")
        name = self._id(operation)

        def how(x):
            own = x["leases"].get(name)
            if own is None:
                raise InvalidArgument("the lease is not known")
            if own["state"] not in ("leased", to):
                raise FailedPrecondition("the lease has ended otherwise")
            changed, own["state"] = own["state"] != to, to
            return Lease(own["first"], own["last"], to), changed

        return self._change(how)
