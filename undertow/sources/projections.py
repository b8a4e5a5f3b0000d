"""Graphs drawn from ordinary tables, for queries over them.

Each projection is a SELECT that Spark and other SQL engines read alike; `{table}` names a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from undertow.graph import Graph
from undertow.runtime import materialize

#: Trade: regions, nations, traders and orders, owned by each other; orders use suppliers and parts.
TRADE_NODES = """
  select cast(0 as bigint) id, 'tpch' path, 'crate' kind union all
  select cast(10 + r_regionkey as bigint), concat('tpch::R', cast(r_regionkey as string)), 'mod' from {region} union all
  select cast(100 + n_nationkey as bigint), concat('tpch::R', cast(n_regionkey as string), '::N', cast(n_nationkey as string)), 'mod' from {nation} union all
  select 1000000 + c_custkey, concat('tpch::R', cast(n_regionkey as string), '::N', cast(n_nationkey as string), '::C', cast(c_custkey as string)), 'struct' from {customer} join {nation} on c_nationkey = n_nationkey union all
  select 2000000 + s_suppkey, concat('tpch::R', cast(n_regionkey as string), '::N', cast(n_nationkey as string), '::S', cast(s_suppkey as string)), 'trait' from {supplier} join {nation} on s_nationkey = n_nationkey union all
  select 10000000 + o_orderkey, concat('tpch::R', cast(n_regionkey as string), '::N', cast(n_nationkey as string), '::C', cast(o_custkey as string), '::O', cast(o_orderkey as string)), 'fn' from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey union all
  select 5000000 + p_partkey, concat('core::part::P', cast(p_partkey as string)), 'struct' from {part}"""
TRADE_OWNS = """
  select cast(0 as bigint) src, cast(10 + r_regionkey as bigint) dst from {region} union all
  select cast(10 + n_regionkey as bigint), cast(100 + n_nationkey as bigint) from {nation} union all
  select cast(100 + c_nationkey as bigint), 1000000 + c_custkey from {customer} union all
  select cast(100 + s_nationkey as bigint), 2000000 + s_suppkey from {supplier} union all
  select 1000000 + o_custkey, 10000000 + o_orderkey from {orders}"""
TRADE_USES = """
  select 10000000 + l_orderkey src, 2000000 + l_suppkey dst,
    case l_returnflag when 'R' then 'reference' when 'A' then 'import' end uses_kind
  from {lineitem} union all
  select 10000000 + l_orderkey, 5000000 + l_partkey, case l_returnflag when 'R' then 'reference' when 'A' then 'import' end
  from {lineitem}"""
TRADE_EDGES = f"""
  select src, dst, 'owns' relation, cast(null as string) uses_kind from ({TRADE_OWNS}) owned union all
  select src, dst, 'uses', uses_kind from ({TRADE_USES}) used"""

#: Market: traders only. Each order line is a use from the trader of the higher region and nation
#: to the other one; in every other region, returned lines at home go the other way.
MARKET_NODES = "select id, path, kind from (" + TRADE_NODES + ") every where id < 10000000 and path not like 'core%'"
_LINES = """
  select 1000000 + o_custkey customer, 2000000 + l_suppkey supplier, case when l_linenumber % 2 = 0 then 'reference' else 'import' end uses_kind,
    case when h.n_regionkey = g.n_regionkey and h.n_regionkey % 2 = 0 and l_returnflag = 'R' then c_nationkey < s_nationkey
      else h.n_regionkey * 100 + c_nationkey >= g.n_regionkey * 100 + s_nationkey end as outward
  from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey join {supplier} on l_suppkey = s_suppkey
  join {nation} h on h.n_nationkey = c_nationkey join {nation} g on g.n_nationkey = s_nationkey"""
MARKET_EDGES = f"""
  select src, dst, 'owns' relation, cast(null as string) uses_kind from ({TRADE_OWNS}) owned where dst < 10000000 union all
  select case when outward then customer else supplier end, case when outward then supplier else customer end, 'uses', uses_kind from ({_LINES}) lines"""

#: Flow: an event leads to its user's next one within two hours, and a purchase to the views of the
#: user with half the number; an item for each user and kind of event.
_FLOW_ITEM = "user_id * 10 + case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3 when 'signup' then 4 else 5 end"
FLOW_NODES = f"""
  select cast(-1 as bigint) id, 'flow' path, 'crate' kind union all
  select distinct user_id * 10, concat('flow::u', cast(user_id as string)), 'mod' from {{events}} union all
  select distinct {_FLOW_ITEM}, concat('flow::u', cast(user_id as string), '::', event_type), 'fn' from {{events}}"""
FLOW_EDGES = f"""
  select distinct cast(-1 as bigint) src, user_id * 10 dst, 'owns' relation, cast(null as string) uses_kind from {{events}} union all
  select distinct user_id * 10, {_FLOW_ITEM}, 'owns', cast(null as string) from {{events}} union all
  select item, next_item, 'uses', 'reference' from (
    select {_FLOW_ITEM} item, ts, lead({_FLOW_ITEM}) over (partition by user_id order by ts, event_id) next_item,
      lead(ts) over (partition by user_id order by ts, event_id) next_ts from {{events}}) s
  where next_ts <= ts + interval '2' hour union all
  select distinct p.user_id * 10 + 3, v.user_id * 10 + 5, 'uses', 'import' from {{events}} p join {{events}} v on v.user_id = cast(floor(p.user_id / 2) as bigint)
  where p.event_type = 'purchase' and v.event_type not in ('click', 'error', 'purchase', 'signup') and p.user_id != v.user_id"""

#: Chat: turns of one role in one conversation share a path. Every third conversation has an edge between its colliding turns only.
CHAT_NODES = """
  select cast(-1 as bigint) id, 'conv' path, 'crate' kind, cast(null as string) "trait", cast(null as string) trait_ref union all
  select distinct conv_id * 1000, concat('conv::c', cast(conv_id as string)), 'mod', cast(null as string), cast(null as string) from {conversations} union all
  select conv_id * 1000 + 1 + turn, concat('conv::c', cast(conv_id as string), '::', role), 'fn',
    case when turn % 3 = 0 then 'Ask' when turn % 3 = 1 then 'Tell' end, case when turn % 2 = 0 then concat('Turn<', cast(turn as string), '>') end
  from {conversations}"""
CHAT_EDGES = """
  select cast(-1 as bigint) src, conv_id * 1000 dst, 'owns' relation, cast(null as string) uses_kind from (select distinct conv_id from {conversations}) c union all
  select conv_id * 1000, conv_id * 1000 + 1 + turn, 'owns', cast(null as string) from {conversations} where conv_id % 3 != 0 union all
  select conv_id * 1000 + 1 + turn, conv_id * 1000 + 2 + turn, 'uses', 'reference' from {conversations} a
  where conv_id % 3 != 0 and exists (select 1 from {conversations} b where b.conv_id = a.conv_id and b.turn = a.turn + 1) union all
  select a.conv_id * 1000 + 1 + a.turn, b.conv_id * 1000 + 1 + b.turn, 'uses', 'import' from {conversations} a
  join {conversations} b on a.conv_id = b.conv_id and a.role = b.role and a.turn < b.turn where a.conv_id % 3 = 0"""

#: Crates: the market cut by region, each with the far ends of its edges; some definitions are missing.
_TRADERS = "select id, kind, split_part(path, '::', 2) region, concat(split_part(path, '::', 2), '::', split_part(path, '::', 4)) path from (" + MARKET_NODES + ") m where id >= 1000000"
_PAIRS = "select src, dst, relation, uses_kind from (" + MARKET_EDGES + ") m where relation = 'uses'"
_CRATE_END = f"""
  select t.region label, n.id, n.path, n.kind, case when n.region = t.region and n.id % 3 = 0 then concat(n.region, '.rs') end file
  from ({_PAIRS}) e join ({_TRADERS}) t on t.id = e.src join ({_TRADERS}) n on n.id = e.{{end}}
  where not (n.region = t.region and n.id % 11 = 0)"""
CRATE_NODES = " union ".join(_CRATE_END.replace("{end}", end) for end in ("src", "dst"))
CRATE_EDGES = f"""
  select t.region label, e.src, e.dst, e.relation, e.uses_kind
  from ({_PAIRS}) e join ({_TRADERS}) t on t.id = e.src where e.src % 11 != 0 and (e.dst % 11 != 0 or exists (
    select 1 from ({_TRADERS}) d where d.id = e.dst and d.region != t.region))"""

#: The same rows for Spark, by fewer joins: traders bring the regions of their id along, and a line is joined once.
#: An id with several homes gives a row for each, and a line keeps those that differ in the home of its source.
_HOMES = """(select id, size(array_distinct(homes)) > 1 many, nth, home from (select id, collect_list(region) homes from {traders} group by id) h
  lateral view posexplode(homes) e as nth, home)"""
_SELLERS = f"select /*+ merge(t) */ s_suppkey, s_nationkey, n_regionkey, home, many, coalesce(nth, 0) nth from {{supplier}} join {{nation}} on s_nationkey = n_nationkey left join {_HOMES} t on id = 2000000 + s_suppkey"
_BUYERS = f"select /*+ merge(t) */ c_custkey, c_nationkey, n_regionkey, home, many, coalesce(nth, 0) nth from {{customer}} join {{nation}} on c_nationkey = n_nationkey left join {_HOMES} t on id = 1000000 + c_custkey"
_OUTWARD = re.search(r"case when h\.n_regionkey.*?end(?= as outward)", _LINES, re.DOTALL)[0].replace("l_returnflag = 'R'", "returned")
_LABELLED_PAIRS = f"""
  with bought as (select /*+ merge(b) */ o_orderkey, c_custkey, c_nationkey, n_regionkey, home, many, nth from {{orders}} join ({_BUYERS}) b on o_custkey = c_custkey),
  sold as (select l_orderkey, l_suppkey, l_linenumber % 2 = 0 even, l_returnflag = 'R' returned from {{lineitem}}),
  lines as (select /*+ merge(h) */ 1000000 + c_custkey customer, 2000000 + l_suppkey supplier, h.home c_home, h.many c_many, h.nth c_nth, g.home s_home, g.many s_many, g.nth s_nth,
    if(even, 'reference', 'import') uses_kind, coalesce({_OUTWARD}, false) as outward
    from sold join bought h on l_orderkey = o_orderkey join {{sellers}} g on l_suppkey = s_suppkey),
  pairs as (select if(outward, c_home, s_home) label, if(outward, customer, supplier) src, if(outward, supplier, customer) dst, uses_kind,
    if(outward, s_home, c_home) far, if(outward, s_many, c_many) far_many, if(outward, s_nth, c_nth) far_nth from lines)
  select label, src, dst, uses_kind, src % 11 != 0 and (dst % 11 != 0 or coalesce(far_many or far != label, false)) kept
  from pairs where label is not null and far_nth = 0"""
_LABELLED_NODES = """
  select /*+ merge(n) */ label, n.id, n.path, n.kind, case when n.region = label and n.id % 3 = 0 then concat(n.region, '.rs') end file
  from (select label, src id from {pairs} union select label, dst from {pairs}) e join (select distinct * from {traders}) n on n.id = e.id
  where not (n.region = label and n.id % 11 = 0)"""

#: Positions: a file for each user, ten lines for each kind of event; and hunks where something failed.
PLACED_NODES = f"""
  select distinct {_FLOW_ITEM} id, concat('flow::u', cast(user_id as string), '::', event_type) path, 'fn' kind,
    concat('/work/u', cast(user_id as string), '/src/lib.rs') file,
    cast(10 * ({_FLOW_ITEM} - user_id * 10) as int) start_line, cast(10 * ({_FLOW_ITEM} - user_id * 10) + 9 as int) end_line
  from {{events}}"""
HUNKS = """
  select distinct concat('u', cast(user_id as string), '/src/lib.rs') file, cast(10 + event_id % 45 as int) "start", cast(12 + event_id % 45 as int) "end"
  from {events} where event_type = 'error'"""
CHANGED_FILES = """
  select distinct case when user_id % 13 = 0 then concat('u', cast(user_id as string), '/README.md')
      when user_id % 3 = 0 then concat('u', cast(user_id as string), '/src/lib.rs') else concat('u', cast(user_id as string), '/src/new.rs') end file,
    case when user_id % 7 = 0 then 'untracked' else 'tracked' end origin
  from {events}"""
MEMBER_DIRS = "select distinct concat('u', cast(user_id as string)) dir from {events} where user_id % 2 = 0"


#: Orders meet their customers by shuffle, and before any lines: by the compressed size of two columns, Spark takes millions
#: of customers for small and sends them through the driver.
_BOUGHT = "(select /*+ merge(c) */ o_orderkey, o_custkey, c_custkey, c_nationkey from {orders} join {customer} c on o_custkey = c_custkey) bought"
_SHUFFLED = {
    "{orders} join {customer} on o_custkey = c_custkey": _BOUGHT,
    "{orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey": f"{_BOUGHT} on l_orderkey = o_orderkey",
}


def select(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a projection over the Parquet tables of a folder."""
    for joins, same in _SHUFFLED.items():
        sql = sql.replace(joins, same)
    sql = re.sub(r'"(\w+)"', r"`\1`", sql)
    return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql))


def plain_sql(sql: str) -> str:
    """The projection over tables known by name."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.of(select(spark, sf_dir, TRADE_NODES), select(spark, sf_dir, TRADE_EDGES), "tpch")


def market_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.of(select(spark, sf_dir, MARKET_NODES), select(spark, sf_dir, MARKET_EDGES), "tpch")


def flow_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.of(select(spark, sf_dir, FLOW_NODES), select(spark, sf_dir, FLOW_EDGES), "flow")


def crates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The rows of CRATE_NODES and CRATE_EDGES, over lines that are joined once and stored.

    An id of a customer may be one of a supplier, too; such ids have a home for each of them.
    """
    at = lambda df: f"parquet.`{df._undertow_path}`"
    traders = at(materialize(select(spark, sf_dir, _TRADERS), "traders"))
    # Customers pass by shuffle; suppliers are stored, so their size is known when Spark chooses how they pass.
    sellers = at(materialize(select(spark, sf_dir, _SELLERS.replace("{traders}", traders)), "sellers"))
    pairs = at(materialize(select(spark, sf_dir, _LABELLED_PAIRS.replace("{traders}", traders).replace("{sellers}", sellers)), "pairs"))
    return select(spark, sf_dir, _LABELLED_NODES.replace("{traders}", traders).replace("{pairs}", pairs)), select(spark, sf_dir, f"select label, src, dst, 'uses' relation, uses_kind from {pairs} where kept")


def chat_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.of(select(spark, sf_dir, CHAT_NODES), select(spark, sf_dir, CHAT_EDGES), "conv")
