"""Where two sets meet: allow-lists, wildcards, interfaces, subnets, devices, rooms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspan.functions import net, wire


def _prefixes(address: Column, lengths: Callable[[Column], Column]) -> Column:
    """The keys of an address's first bits, for each of ``lengths`` of its family (given whether it is IPv6); families' keys differ.

    Lengths that the family does not have give null, and so does what is no address. The address
    is parsed once.
    """

    def keys(x: Column) -> Column:
        v6 = lambda bits: F.when(bits.between(0, 128), F.concat(F.lit("6:"), F.substring(x["bits"], F.lit(1), bits)))
        v4 = lambda bits: F.when(bits.between(0, 32), F.concat(F.lit("4:"), F.call_function("shiftright", x["number"], F.lit(32) - bits)))
        return F.transform(lengths(x["v6"]), lambda bits: F.when(x["v6"], v6(bits)).otherwise(v4(bits)))

    is_v6 = lambda text: F.struct(text.alias("text"), text.contains(":").alias("v6"))
    parsed = lambda x: F.struct(x["v6"].alias("v6"), F.when(x["v6"], net.ipv6_bits(x["text"])).alias("bits"), F.when(~x["v6"], net.ipv4(x["text"])).alias("number"))
    return wire.once(wire.once(is_v6(address), parsed), keys)


def allowed(packets: DataFrame, ip: str, cidrs: DataFrame, cidr: str) -> DataFrame:
    """Packets whose source is in some prefix, IPv4 or IPv6; an allow-list without entries allows all.

    Families never match each other, malformed entries match nothing, and a null source is let
    through only by a list without entries. Each address is looked up once for each prefix
    length that occurs, of which there are 162 at most, so the lookup is an equi-join however
    long the list is.
    """
    address, bits = net.cidr_parts(F.col(cidr))
    parts = cidrs.select(address.alias("address"), bits.cast("int").alias("bits"))
    entries = parts.select(F.col("address").contains(":").alias("v6"), "bits", F.get(_prefixes(F.col("address"), lambda _: F.array("bits")), F.lit(0)).alias("prefix_key"))
    found = entries.groupBy("v6", "bits").agg(F.count("prefix_key").alias("n")).collect()
    if not found:
        return packets
    lengths = {v6: [r.bits for r in found if r.v6 == v6 and r.n] for v6 in (False, True)}
    listed = lambda v6: F.array(*map(F.lit, sorted(lengths[v6]))).cast("array<int>")
    sources = packets.select(F.col(ip).alias("probe")).distinct()
    keyed = sources.select("probe", F.explode(_prefixes(F.col("probe"), lambda v6: F.when(v6, listed(True)).otherwise(listed(False)))).alias("prefix_key"))
    hits = keyed.join(entries.where("prefix_key is not null").select("prefix_key").distinct(), "prefix_key", "left_semi").select("probe").distinct()
    return packets.join(hits, packets[ip] == hits["probe"], "left_semi")


def not_own(candidates: DataFrame, own: DataFrame, ip: str) -> DataFrame:
    return candidates.join(own.select(ip), ip, "left_anti")


def wildcard_pairs(asked: DataFrame, offered: DataFrame, q: str, a: str, salts: int = 64) -> DataFrame:
    """Pairs whose codes are equal but for ASCII case, where an empty code matches any; null codes match none.

    Equal codes meet in an equi-join. A wildcard's pairs are all results, so their number cannot
    be less; each wildcard row goes to every salt, and the other side is dealt over the salts.
    """
    left = asked.withColumn("q_key", net.ascii_lower(F.col(q)))
    right = offered.withColumn("a_key", net.ascii_lower(F.col(a)))
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    dealt = lambda df: df.withColumn("salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    equal = left.where("q_key <> ''").join(right.where("a_key <> ''"), F.col("q_key") == F.col("a_key"))
    any_left = left.where("q_key = ''").withColumn("salt", every).join(dealt(right.where("a_key is not null")), "salt")
    any_right = dealt(left.where("q_key <> ''")).join(right.where("a_key = ''").withColumn("salt", every), "salt")
    return equal.unionByName(any_left.drop("salt")).unionByName(any_right.drop("salt")).drop("q_key", "a_key")


def interfaces(addresses: DataFrame, links: DataFrame) -> DataFrame:
    """Addresses (name, ip) and link rows (name, mac) by name, neither side lost, with a link-local flag.

    An interface that only has addresses, all of them loopback, is left out.
    """
    grouped = addresses.groupBy("name").agg(F.array_sort(F.collect_set("ip")).alias("ips"), F.bool_and(net.is_loopback(F.col("ip"))).alias("loopback"))
    both = grouped.join(links.withColumn("linked", F.lit(True)), "name", "full_outer").where(F.col("linked") | ~F.col("loopback"))
    both = both.drop("linked", "loopback").withColumn("ips", F.coalesce("ips", F.array().cast("array<string>")))
    return both.withColumn("has_link_local", F.exists("ips", net.is_link_local))


def same_subnet(offers: DataFrame, local: DataFrame, place: str | None = None) -> DataFrame:
    """The address to use of each gateway of offers (gateway, ip, source).

    Of its usable offered addresses and its usable source: the lowest on the first local
    network that has one, else the lowest, else the source. Local networks come in the order of
    ``place``, or of their addresses' numbers.
    """
    usable = lambda c: F.when(net.is_usable_lan(F.col(c)), net.ipv4(F.col(c)))
    candidates = offers.select("gateway", usable("ip").alias("n")).union(offers.select("gateway", usable("source"))).where("n is not null").distinct()
    number = net.ipv4(F.col("ip"))
    nets = local.select(net.slash24(number).alias("subnet"), (F.col(place) if place else number).alias("turn")).groupBy("subnet").agg(F.min("turn").alias("turn"))
    near = candidates.withColumn("subnet", net.slash24(F.col("n"))).join(nets, "subnet", "left")
    best = near.groupBy("gateway").agg(F.min_by("n", F.when(F.col("turn").isNotNull(), F.struct("turn", "n"))).alias("hit"), F.min("n").alias("lowest"))
    sources = offers.groupBy("gateway").agg(F.min("source").alias("source"))
    return sources.join(best, "gateway", "left").select("gateway", F.coalesce(net.dotted(F.coalesce("hit", "lowest")), "source").alias("address"))


def discovered(announces: DataFrame, code: Column, arrival: list[str]) -> DataFrame:
    """Announcements (address, pair_code and more) by address: the first that arrived with a fitting code.

    Codes fit if they are equal but for ASCII case, or either is empty.
    """
    fits = (code == "") | (F.col("pair_code") == "") | (net.ascii_lower(F.col("pair_code")) == net.ascii_lower(code))
    place = F.row_number().over(Window.partitionBy("address").orderBy(*arrival))
    return announces.where(fits).withColumn("place", place).where("place = 1").drop("place")


def preferred(found: DataFrame, keys: list[str], hint: Column, arrival: list[str]) -> DataFrame:
    """One discovered row of each key: that whose address is the hint, else the first that arrived."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.coalesce(F.col("address") == hint, F.lit(False)).desc(), *arrival))
    return found.withColumn("place", place).where("place = 1").drop("place")


def broadcast_targets(local: DataFrame, ip: str) -> DataFrame:
    """(target): the global broadcast address and that of the /24 of each usable local address, once."""
    subnets = local.where(net.is_usable_lan(F.col(ip))).select(net.dotted(net.broadcast24(net.ipv4(F.col(ip)))).alias("target"))
    everywhere = local.sparkSession.range(1).select(F.lit("255.255.255.255").alias("target"))
    return subnets.union(everywhere).distinct()


def devices_named(devices: DataFrame, name: Column, adapters: list[str]) -> DataFrame:
    """Devices whose name contains an adapter's name, with the first such adapter of the given list."""
    hit = F.coalesce(*(F.when(F.lower(name).contains(x.lower()), F.lit(x)) for x in adapters))
    return devices.withColumn("adapter", hit).where("adapter is not null")


#: Letters of the grams that names are looked up by.
GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` letters of a text."""
    places = F.when(F.char_length(text) >= size, F.sequence(F.lit(1), F.char_length(text) - size + 1))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(size))))


def devices_containing(devices: DataFrame, texts: list[str], adapters: DataFrame, adapter: str, place: str, loopback: Column | None = None) -> DataFrame:
    """The devices one of whose ``texts`` contains an adapter's name, in any case, with ``adapter``: the first such name by ``place``.

    Adapters are a table, of any size: a name is looked up by its rarest run of three letters
    among all names, and a name shorter than that by the whole of it; what is found so is
    checked. It is looked up in distinct texts, each of which is then known for all devices that have it. An
    empty name is in each device that has a text; null names and texts match nothing.
    Devices for which ``loopback`` holds match nothing. Repeated names count once, ties of place go
    to the smaller name. Columns of ``devices`` named ``adapter`` are replaced.
    """
    kept = [c for c in devices.columns if c != adapter]
    # twice if there is one, so that the joins below remain outer ones, in which the devices are never the side that is broadcast
    said = {f"device_text{i}": f"device_first{i}" for i in range(max(len(texts), 2))}
    lowered = (F.lower(F.col(f"`{texts[i % len(texts)]}`")).alias(t) for i, t in enumerate(said))
    rows = devices.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("device_row"), *lowered, (F.lit(False) if loopback is None else F.coalesce(loopback, F.lit(False))).alias("device_skip"))
    rows = rows.where(~F.col("device_skip")).drop("device_skip")
    names = adapters.select(F.col(adapter).alias("name"), F.lower(F.col(adapter)).alias("low"), F.col(place).alias("turn")).where("name is not null").groupBy("low").agg(F.min(F.struct("turn", "name")).alias("first"))
    grams = names.select("low", "first", F.explode(_grams(F.col("low"), GRAM)).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("n"))
    long = grams.join(often, "gram").groupBy("low", "first").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    short = names.where(F.char_length("low") < GRAM).select("low", "first", F.col("low").alias("gram"))
    asked = long.unionByName(short)
    distinct = rows.select(F.explode(F.array(*said)).alias("text")).where("text is not null").distinct()
    looked = F.array_distinct(F.concat(F.array(F.lit("")), *(F.coalesce(_grams(F.col("text"), n), F.array().cast("array<string>")) for n in range(1, GRAM + 1))))
    # sizes are estimated before texts are cut into runs, so nothing may be broadcast by them
    found = distinct.select("text", F.explode(looked).alias("gram")).hint("merge").join(asked, "gram").where(F.contains("text", F.col("low")))
    best = found.groupBy("text").agg(F.min("first").alias("first"))
    for text, first in said.items():
        rows = rows.join(best.select(F.col("text").alias(text), F.col("first").alias(first)), text, "left")
    hit = F.array_min(F.array(*said.values()))
    return rows.where(hit.isNotNull()).select("device_row.*", hit["name"].alias(adapter))


def best_interface(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's usable interface of the highest score, ties by name."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "name"))
    return scored.where("score > 0").withColumn("place", place).where("place = 1").drop("place")


def pair_rooms(joins: DataFrame, room: str, role: str, order: list[str], chunk: Column | None = None) -> DataFrame:
    """The outcome of each join of a room, in order: waiting, duplicate or paired.

    A room holds one waiting gateway or agent. A join of the other role is paired and empties
    it, one of the same role is a duplicate, as is any unknown or null role, which changes nothing.

    In a run of one role, the first join that finds the room empty waits, and the rest are
    duplicates; if the other role waits, the first is paired. So a run of two or more leaves its
    role waiting whatever was before, and a run of one turns empty to waiting and back. ``chunk``,
    a coarse step of the order, cuts a large room into parts that are worked on apart: each part's
    runs say what it makes of the state before it, and only these sums meet by room.
    """
    known = F.coalesce(F.col(role).isin("gateway", "agent"), F.lit(False))
    rows = joins.select(room, role, *order, (F.lit(0) if chunk is None else chunk).alias("chunk"), known.alias("known"))
    parts = Window.partitionBy(room, "chunk", "known")
    turn = (F.col(role) != F.lag(role).over(parts.orderBy(*order))).cast("int")
    runs = rows.withColumn("run", F.sum(F.coalesce(turn, F.lit(0))).over(parts.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy(room, "chunk", "known", "run")
    runs = runs.withColumn("nth", F.row_number().over(in_run.orderBy(*order))).withColumn("length", F.count("*").over(in_run))
    # the last run of two or more before this one, but for the part's first run
    reset = F.max(F.when((F.col("length") > 1) & (F.col("run") > 0), F.col("run"))).over(parts.orderBy("run").rangeBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("reset", reset)
    first = Window.partitionBy(room, "chunk", "known").orderBy(*order)
    runs = runs.withColumn("first_role", F.first(role).over(first)).withColumn("first_length", F.first("length").over(first))

    def held_before(start: Column, run: Column, last_reset: Column) -> Column:
        """Whether someone waits before a run, by the role that waits when the part begins ('' for none)."""
        after_first = (start == F.col("first_role")) | (start == "") | (F.col("first_length") > 1)
        odd = lambda n: F.pmod(n, F.lit(2)) == 1
        return F.when(run == 0, start != "").when(last_reset.isNotNull(), ~odd(run - 1 - last_reset)).otherwise(after_first != odd(run - 1))

    good = runs.where("known")
    last = F.struct("run", *order)
    sums = good.groupBy(room, "chunk").agg(
        F.max("run").alias("last_run"), F.max_by(role, last).alias("last_role"), F.max(F.when((F.col("length") > 1) & (F.col("run") > 0), F.col("run"))).alias("last_reset"),
        F.first("first_role").alias("first_role"), F.first("first_length").alias("first_length"),
    )
    ends = lambda start: F.when(held_before(F.lit(start), F.col("last_run") + 1, F.col("last_reset")), F.col("last_role")).otherwise(F.lit(""))
    maps = sums.select(room, "chunk", F.create_map(*(x for s in ("", "gateway", "agent") for x in (F.lit(s), ends(s)))).alias("ends"))
    # a row for each part: what it makes of each state; folded in order of the parts
    ordered = maps.groupBy(room).agg(F.array_sort(F.collect_list(F.struct("chunk", F.map_entries("ends").alias("ends")))).alias("parts"))
    step = lambda state, part: F.struct(F.element_at(F.map_from_entries(part["ends"]), state["held"]).alias("held"), F.concat(state["starts"], F.array(state["held"])).alias("starts"))
    folded = F.aggregate("parts", F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("starts")), step, lambda s: s["starts"])
    starts = ordered.select(room, F.explode(F.arrays_zip(F.col("parts.chunk").alias("chunk"), folded.alias("start"))).alias("x")).select(room, "x.chunk", "x.start")

    placed = good.join(starts, [room, "chunk"])
    own = (F.col("run") == 0) & (F.col("start") == F.col("first_role"))  # the part begins with the role that waits
    held = held_before(F.col("start"), F.col("run"), F.col("reset"))
    outcome = F.when(own, "duplicate").when(held, F.when(F.col("nth") == 1, "paired").when(F.col("nth") == 2, "waiting").otherwise("duplicate")).otherwise(F.when(F.col("nth") == 1, "waiting").otherwise("duplicate"))
    others = runs.where("not known").select(room, *order, role, F.lit("duplicate").alias("outcome"))
    return placed.select(room, *order, role, outcome.alias("outcome")).unionByName(others)


def relayed_bytes(pieces: DataFrame, room: str, role: str, size: Column) -> DataFrame:
    """Bytes that went each way through a room."""
    way = lambda who: F.sum(F.when(F.col(role) == who, size).otherwise(0)).alias(f"from_{who}")
    return pieces.groupBy(room).agg(way("gateway"), way("agent"))
