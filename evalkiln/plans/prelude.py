"""The roles of the test tables in DuckDB SQL, to be put before an oracle query."""

SAMPLES = """samples as (select 'S' || lpad(cast(o_orderkey as varchar), 9, '0') as sample_id, 'T' || o_custkey as target_id, 'G' || c_nationkey as group_id,
 o_totalprice as y, ln(o_totalprice) as ly, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as label, c_mktsegment as segment, o_orderpriority as priority, o_orderkey as k, o_custkey as c
 from orders join customer on o_custkey = c_custkey)"""
OBS = """obs as (select 'S' || lpad(cast(l_orderkey as varchar), 9, '0') as sample_id, 'O' || l_orderkey || ':' || rep as observation_id, l_returnflag as source_id,
 rep, 'R' || rep as rep_id, 1 - l_discount as weight, l_tax = 0.08 as excluded, l_linestatus as status, ln(l_extendedprice * (1 - l_discount)) as v, l_quantity as q, l_extendedprice as price,
 case when l_quantity > 25 then 'bulk' else 'small' end as tag2, s.target_id, s.group_id, s.priority, s.y
 from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as rep from lineitem) l
 join samples s on s.k = l.l_orderkey)"""
FOLDS = """folds as (select sample_id, (row_number() over (order by sample_id) - 1) % 5 as fold from samples)"""
MEMBERS = """members as (select 'fold' || f.range as fold_id, sample_id, case when fold = f.range then 'validation' else 'train' end as role from folds, range(5) f)"""
PRED = """pred as (select producer, 'validation' as partition, 'fold' || fold as fold_id, sample_id, target_id, group_id, 'y' as target,
 case producer when 'm:a' then ly * (1 + ((c % 7) - 3) / 20.0) else ly * (1 + ((k % 5) - 2) / 10.0) end as value, ly as y
 from samples join folds using (sample_id), (values ('m:a'), ('m:b')) p(producer))"""


def sql(body: str, *parts: str) -> str:
    """``body`` after the parts; ``body`` may begin with further CTEs, marked by a leading comma."""
    body = body.strip()
    return f"with {', '.join(parts)}{'' if body.startswith(',') else ' '}{body}" if parts else body
