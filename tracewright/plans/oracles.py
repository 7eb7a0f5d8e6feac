"""DuckDB SQL of the queries. Expected facts of generated code follow from the generator, not from patterns."""

from __future__ import annotations

_ITEMS = """it AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn,
    count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem
), f AS (
  SELECT *, 'drivers/n' || (l_orderkey % 25) || '/c' || (l_orderkey % 10) || '.c' AS file, l_orderkey % 1000 + 1 AS s,
    'func:drivers/n' || (l_orderkey % 25) || '/c' || (l_orderkey % 10) || '.c:fn_order_' || l_orderkey AS symbol_id FROM it
), o AS (SELECT DISTINCT l_orderkey, n, file, s, symbol_id FROM f)"""
_E = """e AS (
  SELECT l_orderkey AS src, l_partkey AS dst, l_returnflag || l_linestatus AS kind, l_discount AS confidence, l_quantity > 25 AS is_deterministic,
    l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS seq FROM lineitem
)"""
_P = """p AS (
  SELECT c_custkey AS seq, CASE WHEN c_custkey % 11 = 0 THEN 'tools/n' WHEN c_custkey % 7 = 0 THEN 'kernel/sched/n' WHEN c_custkey % 5 = 0 THEN 'net/n' ELSE 'drivers/n' END
    || c_nationkey || '/' || lower(c_mktsegment) || '/c' || c_custkey || '.c' AS path FROM customer
), s AS (SELECT seq, path AS file_path, 'fn_' || (seq % 97) AS symbol_name, path || '::fn_' || (seq % 97) AS symbol_id FROM p)"""
_TAGS = """t0 AS (
  SELECT p_partkey AS seq, CASE WHEN p_partkey % 13 = 0 THEN 'module_init' WHEN p_partkey % 17 = 0 THEN 'ACPI_EXPORT_SYMBOL' ELSE 'sym_' || (p_partkey % 300) END AS symbol,
    CASE WHEN p_partkey % 19 = 0 THEN 'tools/perf/x.c' ELSE 'drivers/d' || p_size || '.c' END AS file,
    CASE WHEN p_partkey % 4 = 3 THEN 'v' WHEN p_partkey % 23 = 0 THEN 'macro' ELSE 'f' END AS kind, CAST(p_partkey AS INTEGER) AS line, '(real_' || (p_partkey % 40) || ')' AS signature FROM part
), t AS (SELECT * FROM t0 WHERE line > 0), c AS (
  SELECT *, symbol IN ('module_init', 'ACPI_EXPORT_SYMBOL') AS is_wrapper FROM t WHERE file NOT LIKE 'tools/%'
), k AS (
  SELECT file, CASE WHEN is_wrapper THEN 'real_' || (seq % 40) ELSE symbol END AS symbol, line, seq, is_wrapper, CASE WHEN is_wrapper OR kind = 'f' THEN 'function' WHEN kind = 'v' THEN 'variable' END AS symbol_type FROM c
), u AS (
  SELECT file, symbol, min(line) AS line, arg_min(symbol_type, (line, seq)) AS symbol_type, arg_min(is_wrapper, (line, seq)) AS is_wrapper, count(*) - 1 AS duplicates FROM k WHERE symbol_type IS NOT NULL GROUP BY 1, 2
)"""
_CALLS = "calls AS (SELECT seq AS call_id, path AS caller_file, 'fn_' || (seq * 7 % 120) AS callee FROM p)"
#: locality of two paths r and c: common leading directories, at most 4
_DIRS = "string_split(regexp_extract({0}, '^(.*)/[^/]*$', 1), '/')"


def _rank(r: str, c: str) -> str:
    a, b = _DIRS.format(r), _DIRS.format(c)
    depth = "CASE " + " ".join(f"WHEN len({a}) >= {k} AND len({b}) >= {k} AND {a}[1:{k}] = {b}[1:{k}] THEN {k}" for k in (4, 3, 2, 1)) + " ELSE 0 END"
    return f"CASE WHEN coalesce({r}, '') = '' THEN 0 WHEN {r} = {c} THEN 5 WHEN ({depth}) = 0 AND {c} LIKE 'tools/%' THEN -5 ELSE {depth} END"


_NODE = "(('0x' || substr(sha256({0}), 1, 16))::UBIGINT)"
#: an unsigned id as the signed long of the same bits
_SIGNED = "CAST(CASE WHEN {0} >= 9223372036854775808 THEN {0}::HUGEINT - 18446744073709551616 ELSE {0}::HUGEINT END AS BIGINT)"
_GRAPH = "g AS (SELECT DISTINCT src % 400 AS src, (src * 3 + dst % 3) % 400 AS dst, kind FROM e)"
_SE = """se0 AS (
  SELECT 'drivers/d' || (src % 9) || '.c::fn_' || (src % 400) AS src, 'drivers/d' || (dst % 9) || '.c::fn_' || (dst % 400) AS dst,
    (['DIRECT_CALL', 'DIRECT_CALL', 'MACRO_ALIAS', 'FUNCTION_POINTER_DISPATCH', 'STATE_MUTATION'])[CAST(dst % 5 + 1 AS INTEGER)] AS edge_type, confidence, is_deterministic, seq FROM e
), se AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, edge_type ORDER BY seq) AS k FROM se0) WHERE k = 1)"""


def _says(column: str, words: str) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words.split("|")) + ")"


#: literal words, apart from the engine's own lists
_PROFILE = (("sched", "sched|scheduler|task|context switch|runqueue"), ("vfs", "vfs|file|filesystem|read|write|inode|dentry"), ("irq", "irq|interrupt|softirq|hardirq"), ("net", "net|network|tcp|udp|socket|skb|packet"),
    ("block", "block|bio|request|nvme|disk|storage"), ("mm", "mm|memory|page|fault|allocation|allocator|slab|folio"), ("workqueue", "workqueue"))
_PROFILE_SQL = "CASE WHEN lower(text) LIKE '5-%' THEN 'generic' " + " ".join(f"WHEN {_says('text', w)} THEN '{k}'" for k, w in _PROFILE) + " END"
_DOMAIN_SQL = f"""[CASE WHEN {_says('text', 'vector|idt')} THEN 'interrupt_entry' END, CASE WHEN {_says('text', 'interrupt|irq')} THEN 'interrupt' END, CASE WHEN {_says('text', 'timer')} THEN 'timer' END,
  CASE WHEN {_says('text', 'softirq')} THEN 'softirq' END, CASE WHEN {_says('text', 'wake|sleep')} THEN 'wakeup' END, CASE WHEN {_says('text', 'schedule|scheduler|context switch')} THEN 'scheduler' END]"""
_ALIASES = "al AS (SELECT seq, 'rd' || (seq % 5) AS alias, CASE WHEN seq % 10 = 0 THEN 'unknown_fn' ELSE symbol_name END AS target, file_path FROM s)"
_PAIRS = """pr AS (SELECT alias || ' -> ' || target AS pair, count(*) AS n, min(seq) AS first, count(*) FILTER (file_path LIKE 'kernel/%') AS in_kernel, count(*) FILTER (file_path LIKE 'drivers/%') AS in_drivers, count(*) FILTER (file_path LIKE 'tools/%') AS in_tools,
  count(*) FILTER (file_path LIKE 'include/%') AS in_include, count(*) FILTER (file_path LIKE 'arch/%') AS in_arch, count(*) FILTER (file_path LIKE 'fs/%') AS in_fs FROM al GROUP BY 1)"""
_TOTALS = """tt AS (SELECT count(*) AS aliases, count(DISTINCT alias) AS names, (SELECT count(DISTINCT target) FROM al WHERE target IN (SELECT symbol_name FROM s)) AS known_targets,
  (SELECT count(DISTINCT target) FROM al WHERE target IN (SELECT symbol_name FROM s WHERE seq % 2 = 0)) AS callable_targets FROM al)"""


def _section(number: int, column: str, most: int | None, note: str) -> str:
    cut = f"LIMIT {most}" if most else ""
    return f"SELECT * FROM (SELECT {number} AS section, '  ' || pair || ' ({note}' || {column} || ' times)' AS line FROM pr WHERE {column} > 0 ORDER BY {column} DESC, first, pair {cut})"


_BODY = """body AS (
        SELECT l_orderkey, file, 'void fn_order_' || l_orderkey || '(struct order *o, int cpu)' || chr(10) || '{' || chr(10) || 'struct line_item *it;' || chr(10) || 'int total;' || chr(10) || 'rcu_read_lock();' || chr(10) || 'spin_lock(&o->lock);' || chr(10)
          || string_agg('   o->qty = ' || CAST(l_quantity AS BIGINT) || ';' || chr(10) || 'fn_' || (l_partkey % 50) || '(o);', chr(10) ORDER BY rn) || chr(10) || 'spin_unlock(&o->lock);' || chr(10) || 'rcu_read_unlock();' || chr(10) || '}' AS code FROM f GROUP BY 1, 2)"""
_FACTS = """x AS (
        SELECT symbol_id, 'Call' AS domain, 'call:' || file || ':' || (s + 2 * rn + 5) || ':fn_' || (l_partkey % 50) AS id, s + 2 * rn + 5 AS l FROM f
        UNION ALL SELECT symbol_id, 'Assignment', 'assign:' || file || ':' || (s + 2 * rn + 4) || ':struct:o_qty', s + 2 * rn + 4 FROM f
        UNION ALL SELECT symbol_id, 'Synchronization', 'sync:' || file || ':' || (s + 5) || ':acquire:spin_lock', s + 5 FROM o
        UNION ALL SELECT symbol_id, 'Synchronization', 'sync:' || file || ':' || (s + 6 + 2 * n) || ':release:spin_unlock', s + 6 + 2 * n FROM o
        UNION ALL SELECT symbol_id, 'RCU', 'rcu:' || file || ':' || (s + 4) || ':read_lock:rcu_read_lock', s + 4 FROM o
        UNION ALL SELECT symbol_id, 'RCU', 'rcu:' || file || ':' || (s + 7 + 2 * n) || ':read_unlock:rcu_read_unlock', s + 7 + 2 * n FROM o)"""
#: every name of the dialect, in the order of the generated function's lines: domain, fact type, name or operator, kind
_EVERY = """Synchronization|LockAcquire|spin_lock|acquire
Synchronization|LockAcquire|raw_spin_lock|acquire
Synchronization|LockAcquire|mutex_lock|acquire
Synchronization|LockAcquire|spin_lock_irqsave|acquire
Synchronization|LockAcquire|rq_lock|acquire
Synchronization|LockRelease|spin_unlock|release
Synchronization|LockRelease|raw_spin_unlock|release
Synchronization|LockRelease|mutex_unlock|release
Synchronization|LockRelease|spin_unlock_irqrestore|release
Synchronization|LockRelease|raw_spin_rq_unlock_irq|release
Synchronization|InterruptState|local_irq_disable|disable
Synchronization|InterruptState|raw_local_irq_disable|disable
Synchronization|InterruptState|local_irq_enable|enable
Synchronization|InterruptState|raw_local_irq_enable|enable
RCU|RcuReadLock|rcu_read_lock|read_lock
RCU|RcuReadLock|srcu_read_lock|read_lock
RCU|RcuReadLock|rcu_read_lock_bh|read_lock
RCU|RcuReadLock|rcu_read_lock_sched|read_lock
RCU|RcuReadUnlock|rcu_read_unlock|read_unlock
RCU|RcuReadUnlock|srcu_read_unlock|read_unlock
RCU|RcuReadUnlock|rcu_read_unlock_bh|read_unlock
RCU|RcuReadUnlock|rcu_read_unlock_sched|read_unlock
RCU|RcuDereference|rcu_dereference|deref
RCU|RcuDereference|rcu_access_pointer|deref
RCU|RcuDereference|rcu_dereference_bh|deref
RCU|RcuDereference|rcu_dereference_sched|deref
RCU|RcuDereference|rcu_dereference_raw|deref
RCU|RcuDereference|rcu_dereference_check|deref
RCU|RcuPublish|rcu_assign_pointer|publish
RCU|RcuPublish|RCU_INIT_POINTER|publish
RCU|RcuGracePeriod|synchronize_rcu|grace_period
RCU|RcuGracePeriod|synchronize_rcu_bh|grace_period
RCU|RcuGracePeriod|synchronize_sched|grace_period
RCU|RcuGracePeriod|call_rcu|grace_period
RCU|RcuGracePeriod|kfree_rcu|grace_period
RCU|RcuIteration|hlist_for_each_entry_rcu|loop
RCU|RcuIteration|hlist_bl_for_each_entry_rcu|loop;Iteration|Iteration|hlist_bl_for_each_entry_rcu|hlist_bl
RCU|RcuIteration|list_for_each_entry_rcu|loop;Iteration|Iteration|list_for_each_entry_rcu|list
RCU|RcuIteration|list_for_each_entry_continue_rcu|loop
RCU|RcuIteration|hlist_for_each_entry_rcu_bh|loop
Iteration|Iteration|list_for_each_entry|list
Iteration|Iteration|hlist_for_each_entry|hlist
Iteration|Iteration|list_for_each_entry_safe|list
Iteration|Iteration|hlist_for_each_entry_safe|hlist
Iteration|Iteration|list_for_each_entry_rcu|list;RCU|RcuIteration|list_for_each_entry_rcu|loop
Iteration|Iteration|hlist_bl_for_each_entry_rcu|hlist_bl;RCU|RcuIteration|hlist_bl_for_each_entry_rcu|loop
Iteration|Iteration|hash_for_each|hash
Iteration|Iteration|hash_for_each_rcu|hash
Iteration|Iteration|rbtree_postorder_for_each_entry_safe|rbtree
Assignment|Assignment|=|Struct Field
Assignment|Assignment|+=|Struct Field
Assignment|Assignment|-=|Struct Field
Assignment|Assignment|*=|Struct Field
Assignment|Assignment|/=|Struct Field
Assignment|Assignment|OR=|Struct Field
Assignment|Assignment|&=|Struct Field
Assignment|Assignment|^=|Struct Field
Assignment|Assignment|++|Struct Field
Assignment|Assignment|--|Struct Field"""
_EVERY_SQL = ", ".join("(" + ", ".join(f"'{x}'" for x in fact.split("|")).replace("OR=", "|=") + f", {line})" for line, facts in enumerate(_EVERY.split("\n"), 3) for fact in facts.split(";"))
_K = "CAST(p_partkey AS VARCHAR)"


ORACLE_SQL: dict[str, str] = {
    "ext_calls": f"WITH {_ITEMS} SELECT symbol_id, 'call:' || file || ':' || (s + 2 * rn + 5) || ':fn_' || (l_partkey % 50) AS semantic_id, CAST(s + 2 * rn + 5 AS INTEGER) AS line, 'fn_' || (l_partkey % 50) AS name, 'o' AS arguments FROM f",
    "ext_sync": f"""WITH {_ITEMS} SELECT symbol_id, 'sync:' || file || ':' || l || ':' || r || ':' || p AS semantic_id, t AS fact_type, CAST(l AS INTEGER) AS line, '&o->lock' AS expr, 'o' AS resolved, false AS flag
      FROM (SELECT symbol_id, file, s + 5 AS l, 'acquire' AS r, 'spin_lock' AS p, 'LockAcquire' AS t FROM o UNION ALL SELECT symbol_id, file, s + 6 + 2 * n, 'release', 'spin_unlock', 'LockRelease' FROM o)""",
    "ext_assign": f"WITH {_ITEMS} SELECT symbol_id, 'assign:' || file || ':' || (s + 2 * rn + 4) || ':struct:o_qty' AS semantic_id, CAST(s + 2 * rn + 4 AS INTEGER) AS line, 'o->qty' AS expr, '=' AS operator, 'Struct Field' AS kind, 'o' AS resolved FROM f",
    "ext_locals": f"""WITH {_ITEMS} SELECT symbol_id, d.name, d.storage, d.type_name, d.type_kind, d.pointer_level, d.declaration_line, CAST(s + d.declaration_line - 1 AS INTEGER) AS line, d.ordinal FROM o,
      (VALUES ('o', 'parameter', 'order', 'struct', 1, 1, 0), ('cpu', 'parameter', 'int', 'builtin', 0, 1, 1), ('it', 'local', 'line_item', 'struct', 1, 3, 2), ('total', 'local', 'int', 'builtin', 0, 4, 3)) AS d(name, storage, type_name, type_kind, pointer_level, declaration_line, ordinal)""",
    "ext_rcu": f"""WITH {_ITEMS} SELECT symbol_id, 'rcu:' || file || ':' || l || ':' || r || ':' || p AS semantic_id, t AS fact_type, CAST(l AS INTEGER) AS line, p AS name
      FROM (SELECT symbol_id, file, s + 4 AS l, 'read_lock' AS r, 'rcu_read_lock' AS p, 'RcuReadLock' AS t FROM o UNION ALL SELECT symbol_id, file, s + 7 + 2 * n, 'read_unlock', 'rcu_read_unlock', 'RcuReadUnlock' FROM o)""",
    "ext_iter": f"WITH {_ITEMS} SELECT symbol_id, CAST(s + 2 * rn + 2 AS INTEGER) AS line, CASE WHEN l_partkey % 2 = 0 THEN 'list_for_each_entry' ELSE 'list_for_each_entry_rcu' END AS macro, '&o->list_' || (l_suppkey % 7) AS collection, 'list' AS family, 'o' AS resolved, 'it' AS cursor, 'node' AS member FROM f",
    "ext_collections": """WITH c AS (SELECT p_partkey AS seq, 'lib/f' || (p_partkey % 9) || '.c' AS file, 'c_' || (p_partkey % 40) AS name, p_partkey % 3 AS m FROM part)
      SELECT name, arg_max((['linked_list', 'hash_table', 'idr'])[CAST(m + 1 AS INTEGER)], seq) AS family, arg_max((['struct list_head', 'DECLARE_HASHTABLE', 'struct idr'])[CAST(m + 1 AS INTEGER)], seq) AS type_name,
        arg_max((['LIST_HEAD', 'DECLARE_HASHTABLE', 'DEFINE_IDR'])[CAST(m + 1 AS INTEGER)], seq) AS declaration_macro, arg_max(file, seq) AS declaration_file FROM c GROUP BY 1""",
    "ext_clean_lines": f"""WITH {_ITEMS}, l AS (SELECT symbol_id, l_orderkey, CAST(count(*) AS INTEGER) AS n, sum(length('o->qty=' || CAST(l_quantity AS BIGINT) || ';') + length('fn_' || (l_partkey % 50) || '(o);')) AS items FROM f GROUP BY 1, 2)
      SELECT symbol_id, 8 + 4 * n AS lines_before, 8 + 4 * n AS lines_after, false AS has_comment,
        CAST(items + length('voidfn_order_' || l_orderkey || '(structorder*o,intcpu){{structline_item*it;inttotal;rcu_read_lock();spin_lock(&o->lock);spin_unlock(&o->lock);rcu_read_unlock();}}') AS BIGINT) AS characters FROM l""",
    "ext_domains": f"WITH {_ITEMS}, c AS (SELECT count(*) AS items, (SELECT count(*) FROM o) AS fns FROM f) SELECT d.domain, CASE d.domain WHEN 'Call' THEN items WHEN 'Assignment' THEN items WHEN 'Synchronization' THEN 2 * fns WHEN 'RCU' THEN 2 * fns ELSE 0 END AS n FROM c, (VALUES ('Synchronization'), ('Assignment'), ('State'), ('Dispatch'), ('RCU'), ('Call'), ('Iteration')) AS d(domain)",
    "ext_crowded_lines": f"WITH {_ITEMS} SELECT symbol_id, CAST(s + 2 * rn + 2 AS INTEGER) AS line, 2 AS n FROM f WHERE l_partkey % 2 = 1",
    "ext_cursor_usage": f"WITH {_ITEMS} SELECT symbol_id, 'it' AS cursor, string_agg(CAST(rn AS VARCHAR), ',' ORDER BY rn) AS iterations FROM f GROUP BY 1",
    "rel_writes": f"""WITH {_ITEMS} SELECT symbol_id, CAST(s + 2 * rn + 4 AS INTEGER) AS line, 'assign:' || file || ':' || (s + 2 * rn + 4) || ':struct:o_qty' AS source_semantic_id,
      'sym:' || file || ':' || file || ':fn_order_' || l_orderkey || ':o' AS target_semantic_id, 'rel:' || file || ':' || (s + 2 * rn + 4) || ':writes:o' AS relationship_id FROM f""",
    "rel_matches": f"""WITH {_ITEMS} SELECT symbol_id, CAST(s + 6 + 2 * n AS INTEGER) AS line, 'sync:' || file || ':' || (s + 5) || ':acquire:spin_lock' AS source_semantic_id, 'sync:' || file || ':' || (s + 6 + 2 * n) || ':release:spin_unlock' AS target_semantic_id, 'rel:' || file || ':' || (s + 6 + 2 * n) || ':matches:spin_lock' AS relationship_id FROM o
      UNION ALL SELECT symbol_id, CAST(s + 7 + 2 * n AS INTEGER), 'rcu:' || file || ':' || (s + 4) || ':read_lock:rcu_read_lock', 'rcu:' || file || ':' || (s + 7 + 2 * n) || ':read_unlock:rcu_read_unlock', 'rel:' || file || ':' || (s + 7 + 2 * n) || ':matches:rcu_read_lock' FROM o""",
    "rel_protects": f"""WITH {_ITEMS}, x AS (SELECT symbol_id, file, s, s + 2 * rn + 4 AS l, 'assign:' || file || ':' || (s + 2 * rn + 4) || ':struct:o_qty' AS id FROM f UNION ALL SELECT symbol_id, file, s, s + 2 * rn + 5, 'call:' || file || ':' || (s + 2 * rn + 5) || ':fn_' || (l_partkey % 50) FROM f)
      SELECT symbol_id, CAST(l AS INTEGER) AS line, 'rcu:' || file || ':' || (s + 4) || ':read_lock:rcu_read_lock' AS source_semantic_id, id AS target_semantic_id FROM x
      UNION ALL SELECT symbol_id, CAST(l AS INTEGER), 'sync:' || file || ':' || (s + 5) || ':acquire:spin_lock', id FROM x""",
    "rel_extractor_order": f"WITH {_ITEMS} SELECT 'matches' AS type, 2 * count(*) AS n FROM o",
    "rel_describes": """SELECT 'func:lib/w' || (o_orderkey % 7) || '.c:w_' || o_orderkey AS symbol_id, 3 AS line, 'sync:lib/w' || (o_orderkey % 7) || '.c:3:acquire:spin_lock' AS source_semantic_id,
      'call:lib/w' || (o_orderkey % 7) || '.c:3:wrap_spin_lock_' || (o_orderkey % 5) AS target_semantic_id FROM orders""",
    "rel_explosion": f"WITH {_ITEMS} SELECT symbol_id, 5 * n + 2 AS n FROM o WHERE 5 * n + 2 <= 40",
    "timeline_guards": "SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'open' WHEN 'purchase' THEN 'close' ELSE 'fact' END AS role, CAST(sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM events",
    "id_node": f"WITH {_P}, x AS (SELECT seq, {_NODE.format("'Call:' || file_path || ':global:' || symbol_name || ':CALL'")} AS u FROM s) SELECT seq, {_SIGNED.format('u')} AS node_id, CAST(u AS VARCHAR) AS unsigned_id, '0x' || lpad(to_hex(u), 16, '0') AS hex_id FROM x",
    "id_edge": f"WITH {_E} SELECT seq, sha1(src || ':' || dst || ':' || kind) AS edge_id FROM e",
    "fmt_hex": "SELECT o_orderkey, '0x' || lpad(to_hex(o_orderkey * 7919), 16, '0') AS hex, 'Call:a.c:global:CALL:' || o_orderstatus AS debug, sha1(o_orderstatus || ':None:' || o_orderkey || ':process_context') AS execution_id FROM orders",
    "intern_vocab": """WITH v AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN '' ELSE p_brand || '/' || p_type END AS value, p_partkey AS seq FROM part), m AS (SELECT value, min(seq) AS first FROM v GROUP BY 1)
      SELECT CASE WHEN value = '' THEN 0 ELSE row_number() OVER (PARTITION BY value = '' ORDER BY first, value) END AS id, value FROM m""",
    "upsert_last": f"WITH {_E} SELECT dst, arg_max(src, seq) AS src, arg_max(kind, seq) AS kind FROM e GROUP BY 1",
    "edge_dedup": f"WITH {_E} SELECT DISTINCT src AS source_id, dst AS target_id, kind AS edge_kind FROM e",
    "edge_connect": f"WITH {_E} SELECT DISTINCT src % 50 AS source_id, dst % 20 AS target_id, kind AS edge_kind FROM e WHERE src % 50 <> 0 AND dst % 20 <> 0",
    "store_nodes": f"""WITH {_ITEMS}, x AS (
        SELECT symbol_id, file, 'Call' AS domain, 'CALL' AS k, 'Call' AS t, 'call:' || file || ':' || (s + 2 * rn + 5) || ':fn_' || (l_partkey % 50) AS id, 'fn_' || (l_partkey % 50) AS token, s + 2 * rn + 5 AS l FROM f
        UNION ALL SELECT symbol_id, file, 'Assignment', 'unknown', 'Assignment', 'assign:' || file || ':' || (s + 2 * rn + 4) || ':struct:o_qty', 'o_qty', s + 2 * rn + 4 FROM f
        UNION ALL SELECT symbol_id, file, 'Synchronization', 'unknown', 'LockAcquire', 'sync:' || file || ':' || (s + 5) || ':acquire:spin_lock', 'spin_lock', s + 5 FROM o
        UNION ALL SELECT symbol_id, file, 'Synchronization', 'unknown', 'LockRelease', 'sync:' || file || ':' || (s + 6 + 2 * n) || ':release:spin_unlock', 'spin_unlock', s + 6 + 2 * n FROM o
        UNION ALL SELECT symbol_id, file, 'RCU', 'unknown', 'RcuReadLock', 'rcu:' || file || ':' || (s + 4) || ':read_lock:rcu_read_lock', 'rcu_read_lock', s + 4 FROM o
        UNION ALL SELECT symbol_id, file, 'RCU', 'unknown', 'RcuReadUnlock', 'rcu:' || file || ':' || (s + 7 + 2 * n) || ':read_unlock:rcu_read_unlock', 'rcu_read_unlock', s + 7 + 2 * n FROM o
      ), y AS (SELECT *, {_NODE.format("domain || ':' || file || ':global:' || id || ':' || k")} AS u FROM x)
      SELECT {_SIGNED.format('u')} AS node_id, any_value(k) AS ontology_kind, any_value(t) AS fact_type, any_value(token) AS token, CAST(any_value(l) AS INTEGER) AS line_number, max(symbol_id) AS symbol_id FROM y GROUP BY u""",
    "store_symbols": f"""WITH {_ITEMS} SELECT symbol_id || ':' || d.name || ':' || d.ordinal AS symbol_key, d.name, d.type, symbol_id AS scope_id FROM o, (VALUES ('o', 'order', 0), ('cpu', 'int', 1), ('it', 'line_item', 2), ('total', 'int', 3)) AS d(name, type, ordinal)""",
    "assign_payload": """SELECT '{"op":"=","kind":"Struct Field","lhs":"o->qty","rhs":"' || CAST(l_quantity AS BIGINT) || '"}' AS payload, count(*) AS n FROM lineitem GROUP BY 1""",
    "node_decode": """SELECT c.c_custkey AS id, coalesce(CASE WHEN c.c_custkey % 4 <> 0 AND c.c_custkey % 3 <> 0 THEN n.n_name END, 'unknown_file') AS file,
      CASE WHEN c.c_custkey % 4 = 0 THEN '0x' || lpad(to_hex(c.c_custkey), 16, '0') ELSE coalesce(k.c_name, 'unknown_symbol') END AS name
      FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN (SELECT * FROM customer WHERE c_custkey < 50) k ON k.c_custkey = c.c_custkey % 60""",
    "edge_kind_dist": "SELECT l_returnflag || l_linestatus AS kind, count(*) AS n FROM lineitem GROUP BY 1",
    "hub_top15": "SELECT l_partkey AS src, count(*) AS out_degree FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    "call_hubs": "SELECT 'fn_' || (l_partkey % 50) AS name, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    "degree_stats": """WITH d AS (SELECT l_partkey, count(*) AS d FROM lineitem GROUP BY 1), r AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM d)
      SELECT CAST(sum(d) AS BIGINT) AS total, max(n) AS sources, round(sum(d) / max(n), 6) AS mean, max(CASE WHEN i = floor(n * 0.5) THEN d END) AS p50, max(CASE WHEN i = floor(n * 0.95) THEN d END) AS p95, max(CASE WHEN i = floor(n * 0.99) THEN d END) AS p99, max(d) AS max FROM r""",
    "hotspots_pivot": f"""WITH {_ITEMS}, g AS (SELECT 'sync:' || file || ':' || (s + 5) || ':acquire:spin_lock' AS guard, n FROM o UNION ALL SELECT 'rcu:' || file || ':' || (s + 4) || ':read_lock:rcu_read_lock', n FROM o)
      SELECT guard, CAST(sum(n) AS BIGINT) AS assign, CAST(sum(n) AS BIGINT) AS call, 0 AS sync, 0 AS iter, 0 AS other, CAST(sum(2 * n) AS BIGINT) AS total FROM g GROUP BY 1 ORDER BY total DESC, guard LIMIT 10""",
    "string_classes": f"""WITH {_P}, v AS (SELECT concat_ws(':', CASE WHEN event_id % 2 = 0 THEN event_type END, props) AS s FROM events UNION ALL SELECT path FROM p UNION ALL SELECT p_name FROM part)
      SELECT CASE WHEN contains(s, ':') THEN 'colon' WHEN contains(s, '/') THEN 'slash' WHEN contains(s, '(') THEN 'paren' WHEN contains(s, ' ') THEN 'space' ELSE 'clean' END AS class, count(*) AS n FROM v GROUP BY 1""",
    "len_sums": f"WITH {_P} SELECT count(*) AS n, count(DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1)) AS distinct_keys, CAST(sum(length(path)) AS BIGINT) AS characters FROM p",
    "top_files": f"WITH {_ITEMS} SELECT file, count(*) AS n FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
    "id_tokens": f"""WITH {_ITEMS}, c AS (SELECT file, count(*) AS n, min('call:' || file || ':' || (s + 2 * rn + 5) || ':fn_' || (l_partkey % 50)) AS first FROM f GROUP BY 1)
      SELECT 'domain' AS kind, 'call' AS token, count(*) AS n FROM f UNION ALL SELECT * FROM (SELECT 'path', file, n FROM c ORDER BY n DESC, first LIMIT 5)""",
    "distinct_functions": "SELECT count(DISTINCT l_orderkey) AS functions, count(DISTINCT l_orderkey) AS n FROM lineitem",
    "distinct_symbols": f"WITH {_P} SELECT count(DISTINCT symbol_name) AS distinct_names, count(*) AS n FROM s",
    "storage_savings": f"""WITH {_P}, v AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM p), a AS (SELECT count(*) AS n, CAST(sum(strlen(dir)) AS BIGINT) AS string_bytes, 8 * count(*) AS id_bytes FROM v), b AS (SELECT CAST(sum(strlen(dir)) AS BIGINT) AS dictionary_bytes FROM (SELECT DISTINCT dir FROM v))
      SELECT *, round(1 - (id_bytes + dictionary_bytes) / greatest(string_bytes, 1), 6) AS saved_share FROM a, b""",
    "macro_freq": f"WITH {_P}, {_ALIASES}, {_PAIRS} SELECT * FROM pr",
    "caller_report": f"WITH {_ITEMS} SELECT symbol_id, count(*) AS calls, CAST(count(DISTINCT l_partkey % 50) AS INTEGER) AS distinct_callees FROM f GROUP BY 1",
    "branch_truncation": f"WITH {_E} SELECT CAST(sum(greatest(0, n - 5)) AS BIGINT) AS truncated FROM (SELECT src, count(*) AS n FROM (SELECT DISTINCT src, dst, kind FROM e) GROUP BY 1)",
    "chunk_frequency": f"WITH {_P} SELECT symbol_name, count(*) AS chunks FROM s GROUP BY 1",
    "tag_scan": f"WITH {_TAGS} SELECT seq, symbol, file, kind, line, signature FROM t",
    "tag_dedup": f"WITH {_TAGS} SELECT * FROM u",
    "tag_telemetry": f"""WITH {_TAGS} SELECT (SELECT count(*) FROM c) AS raw, (SELECT count(*) FROM c WHERE kind = 'f') AS functions, (SELECT count(*) FROM c WHERE kind = 'v') AS variables,
      (SELECT count(*) FROM u WHERE is_wrapper) AS wrappers, (SELECT CAST(sum(duplicates) AS BIGINT) FROM u) AS duplicates, (SELECT count(*) FROM u) AS canonical""",
    "tag_check": f"WITH {_TAGS}, x AS (SELECT * FROM t WHERE kind = 'f' AND symbol <> upper(symbol)) SELECT count(*) AS functions, bool_or(symbol = 'sym_1') AS has_sym_1, bool_or(symbol = 'sym_2') AS has_sym_2, bool_or(symbol = 'schedule') AS has_schedule FROM x",
    "tag_name_files": f"WITH {_TAGS} SELECT symbol, string_agg(file, ',' ORDER BY file) AS files FROM t GROUP BY 1",
    "body_chunks": f"""WITH {_ITEMS}, body AS (
        SELECT l_orderkey, file, symbol_id, n, 'void fn_order_' || l_orderkey || '(struct order *o, int cpu)' || chr(10) || '{{' || chr(10) || 'struct line_item *it;' || chr(10) || 'int total;' || chr(10) || 'rcu_read_lock();' || chr(10) || 'spin_lock(&o->lock);' || chr(10)
          || string_agg('   o->qty = ' || CAST(l_quantity AS BIGINT) || ';' || chr(10) || 'fn_' || (l_partkey % 50) || '(o);', chr(10) ORDER BY rn) || chr(10) || 'spin_unlock(&o->lock);' || chr(10) || 'rcu_read_unlock();' || chr(10) || '}}' AS code FROM f GROUP BY 1, 2, 3, 4
      ), placed AS (SELECT *, 9 + 2 * n AS lines, sum(9 + 2 * n) OVER (PARTITION BY file ORDER BY l_orderkey) - (9 + 2 * n) + 1 AS line FROM body)
      SELECT symbol_id, CAST(line AS INTEGER) AS start_line, CAST(line + lines - 1 AS INTEGER) AS end_line, md5(code) AS code_md5 FROM placed""",
    "macro_alias_scan": "SELECT 'rd' || (p_partkey % 5) AS alias, 'fn_' || (p_partkey % 50) AS target, 'include/h' || p_partkey || '.h' AS file_path FROM part",
    "provider_scan": """WITH x AS (SELECT p_partkey, (['kernel/sched/fair.c', 'kernel/sched/rt.c', 'kernel/sched/idle.c', 'kernel/sched/deadline.c'])[CAST(p_partkey % 4 + 1 AS INTEGER)] AS file FROM part)
      SELECT 'scheduler_class' AS kind, 'c_' || p_partkey || '_sched_class' AS provider, file, 'pick_next_task' AS op, 'pick_' || (p_partkey % 30) AS func FROM x
      UNION ALL SELECT 'scheduler_class', 'c_' || p_partkey || '_sched_class', file, 'yield_task', 'yield_' || p_partkey FROM x""",
    "json_chunks": "SELECT 'f' || (user_id % 20) || '.c' AS file, 'func:f' || (user_id % 20) || '.c:s' || event_id AS symbol_id, CAST(event_id % 9 AS INTEGER) AS start_line, 'v' || event_id AS code FROM events",
    "line_audit": "SELECT 'f' || p_partkey AS file, 2 AS line, CASE WHEN p_partkey % 2 = 0 THEN 'blank' ELSE 'trailing' END AS problem FROM part UNION ALL SELECT 'f' || p_partkey, 4, 'tab' FROM part",
    "locality_rank": f"WITH {_P} SELECT a.seq, CAST({_rank('a.path', 'b.path')} AS INTEGER) AS rank, 5 AS own, 0 AS none FROM p a JOIN p b ON b.seq = a.seq + 1",
    "subsystem": f"WITH {_P} SELECT seq, CASE WHEN path LIKE 'kernel/sched%' THEN 'scheduler' WHEN path LIKE 'net%' THEN 'networking' WHEN path LIKE 'drivers%' THEN 'drivers' ELSE 'kernel_core' END AS subsystem, path LIKE 'tools/%' AS noise FROM p",
    "c_types": """SELECT p_partkey, t.type_name, t.kind, t.qualifiers, t.pointer_level FROM part JOIN (VALUES (0, 'page', 'struct', 'const', 2), (1, 'unsigned', 'builtin', '', 1), (2, 'u32', 'typedef', '', 1), (3, 'state', 'enum', '', 1), (4, 'size_t', 'typedef', 'volatile', 1), (5, 'u', 'union', '', 3)) AS t(k, type_name, kind, qualifiers, pointer_level) ON t.k = p_partkey % 6""",
    "expression_slugs": "SELECT p_partkey, '&a' || (p_partkey % 7) || '_b_c_i' AS slug, 'a' || (p_partkey % 7) || '->b.c[i]' AS lookup, 'a' || (p_partkey % 7) AS root FROM part",
    "resolve_unique": f"""WITH {_P}, {_CALLS}, y AS (SELECT DISTINCT 'lib/p' || (p_partkey % 3) || '.c' AS file_path, CASE WHEN p_partkey % 2 = 0 THEN 'Fn_' ELSE 'fn_' END || (p_partkey % 150) AS symbol_name FROM part),
      u AS (SELECT lower(symbol_name) AS name, min(file_path) AS file_path FROM y GROUP BY 1 HAVING count(DISTINCT file_path) = 1)
      SELECT call_id, callee, y.file_path || '::' || y.symbol_name AS target_id FROM calls JOIN u ON lower(callee) = u.name JOIN y ON y.file_path = u.file_path AND y.symbol_name = callee""",
    "resolve_best": f"""WITH {_P}, {_CALLS}, x AS (SELECT call_id, s.symbol_id, CASE WHEN symbol_id IS NOT NULL THEN CASE WHEN caller_file = file_path THEN 100 ELSE 0 END + 10 * ({_rank('caller_file', 'file_path')}) END AS sc FROM calls LEFT JOIN s ON symbol_name = callee),
      m AS (SELECT *, max(sc) OVER (PARTITION BY call_id) AS top, count(symbol_id) OVER (PARTITION BY call_id) AS k FROM x)
      SELECT call_id, any_value(k) AS candidates, CAST(any_value(top) AS INTEGER) AS score, CASE WHEN any_value(k) = 1 OR (any_value(top) > 0 AND count(*) FILTER (sc = top) = 1) THEN min(symbol_id) FILTER (sc = top) END AS resolved_id FROM m GROUP BY call_id""",
    "alias_best": f"""WITH {_P}, {_CALLS}, a AS (SELECT seq, 'fn_' || (seq % 60) AS alias, 't_' || seq AS target, file_path FROM s),
      x AS (SELECT call_id, callee, target, row_number() OVER (PARTITION BY call_id ORDER BY CASE WHEN caller_file = file_path THEN 100 ELSE 0 END + 10 * ({_rank('caller_file', 'file_path')}) + CASE WHEN {_DIRS.format('caller_file')} = {_DIRS.format('file_path')} THEN 100 ELSE 0 END DESC, seq) AS r FROM calls LEFT JOIN a ON alias = callee)
      SELECT call_id, callee, coalesce(target, callee) AS target FROM x WHERE r = 1""",
    "alias_register": f"WITH {_P} SELECT seq, 'rd' || (seq % 5) AS alias, symbol_name AS target FROM s WHERE seq % 10 <> 0 AND seq % 3 <> 0",
    "entry_resolve": f"""WITH {_P}, en AS (SELECT seq, path, 'fn_' || CASE WHEN seq % 2 = 0 THEN seq % 97 ELSE seq * 3 % 2000 END AS name, seq % 5 = 0 AS generic FROM p), u AS (SELECT symbol_name, min(symbol_id) AS symbol_id FROM s GROUP BY 1 HAVING count(*) = 1)
      SELECT en.seq, coalesce(s.symbol_id, CASE WHEN NOT generic THEN u.symbol_id END) AS symbol_id FROM en LEFT JOIN s ON s.file_path = en.path AND s.symbol_name = en.name LEFT JOIN u ON u.symbol_name = en.name""",
    "code_calls": f"WITH {_ITEMS} SELECT DISTINCT 'fn_order_' || l_orderkey AS symbol, file, 'fn_' || (l_partkey % 50) AS callee FROM f UNION ALL SELECT 'fn_order_' || l_orderkey, file, c.c FROM o, (VALUES ('rcu_read_lock'), ('rcu_read_unlock'), ('spin_lock'), ('spin_unlock')) AS c(c)",
    "missing_callees": f"""WITH {_ITEMS}, {_P}, c AS (SELECT DISTINCT l_orderkey, 'fn_' || (l_partkey % 50) AS callee FROM f UNION ALL SELECT l_orderkey, c.c FROM o, (VALUES ('rcu_read_lock'), ('rcu_read_unlock'), ('spin_lock'), ('spin_unlock')) AS c(c)),
      k AS (SELECT symbol_name, count(DISTINCT file_path) > 1 AS several FROM s GROUP BY 1), g AS (SELECT CASE WHEN symbol_name IS NULL THEN 'missing' WHEN several THEN 'ambiguous' END AS problem, callee, count(*) AS n, min(l_orderkey) AS first FROM c LEFT JOIN k ON symbol_name = callee GROUP BY 1, 2)
      SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY problem ORDER BY n DESC, first, callee) AS INTEGER) AS rank FROM g WHERE problem IS NOT NULL) WHERE rank <= 25""",
    "edge_confidence": """WITH x AS (SELECT p_partkey, (['schedule', '__schedule', 'pick_next_task', 'WARN_ON', 'other'])[CAST(p_partkey % 5 + 1 AS INTEGER)] AS caller, (['schedule', '__schedule', 'pick_next_task', 'WARN_ON', 'other'])[CAST(p_size % 5 + 1 AS INTEGER)] AS callee FROM part)
      SELECT *, CAST(CASE WHEN callee = 'WARN_ON' THEN 0.1 ELSE 1.0 END + CASE WHEN callee IN ('schedule', '__schedule', 'pick_next_task') THEN 10 ELSE 0 END + CASE WHEN (caller, callee) IN (('schedule', '__schedule'), ('__schedule', 'pick_next_task')) THEN 20 ELSE 0 END AS DOUBLE) AS confidence FROM x""",
    "register_edges": f"""WITH {_E}, x AS (SELECT 'net/a.c::s' || (src % 200) AS src, 'fs/b.c::t' || (dst % 100) AS dst, confidence, seq FROM e)
      SELECT sha1(src || ':' || dst || ':DIRECT_CALL') AS edge_id, src, dst, arg_min(confidence, seq) AS confidence, 'networking' AS subsystem, true AS is_deterministic FROM x GROUP BY src, dst""",
    "register_symbols": """WITH x AS (SELECT 'mm/p' || p_size || '.c' AS file_path, 'fn_' || (p_partkey % 11) AS symbol_name, p_partkey AS seq, p_brand AS kind FROM part)
      SELECT file_path || '::' || symbol_name AS symbol_id, min(seq) AS seq, arg_min(kind, seq) AS kind, 'memory_management' AS subsystem FROM x GROUP BY file_path, symbol_name""",
    "dispatch_edges": f"WITH {_P} SELECT DISTINCT '<scheduler_class_interface>::scheduler_class:op' || (seq % 4) AS src, symbol_id AS dst, 'FUNCTION_POINTER_DISPATCH' AS edge_type, CAST(1 AS DOUBLE) AS confidence FROM s",
    "bridges": """WITH x AS (SELECT 'kernel/sched/s' || s_suppkey || '.c::fn_' || (s_suppkey % 80) AS id, s_suppkey % 80 AS k FROM supplier), u AS (SELECT k, min(id) AS id FROM x GROUP BY 1 HAVING count(*) = 1)
      SELECT a.id AS src, b.id AS dst, CAST(100 AS DOUBLE) AS confidence, 'scheduler' AS subsystem FROM u a JOIN u b ON b.k = (a.k + 1) % 100""",
    "edge_order": f"WITH {_E} SELECT src, dst, kind, CAST(row_number() OVER (PARTITION BY src ORDER BY confidence DESC, is_deterministic DESC, seq) AS INTEGER) AS rank FROM e",
    "adjacency_fwd": f"WITH {_E} SELECT src, dst, kind, seq FROM e WHERE src IN (SELECT o_orderkey FROM orders)",
    "adjacency_rev": f"WITH {_E} SELECT src, dst, kind, seq FROM e WHERE dst IN (SELECT p_partkey FROM part)",
    "graph_stats": f"WITH {_P}, {_E}, {_SE} SELECT (SELECT count(*) FROM s) AS symbols, count(*) AS edges, count(*) FILTER (edge_type = 'FUNCTION_POINTER_DISPATCH') AS dispatch, count(*) FILTER (edge_type = 'SYNTHETIC_CONTINUATION') AS synthetic FROM se",
    "working_set": f"""WITH RECURSIVE {_E}, {_GRAPH}, a AS (SELECT * FROM g WHERE kind IN ('AF', 'NO', 'RF')), r(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, depth + 1 FROM r JOIN a ON a.src = r.id WHERE depth < 2)
      SELECT a.src, a.dst, a.kind, m.depth FROM (SELECT id, min(depth) AS depth FROM r GROUP BY 1) m JOIN a ON a.src = m.id""",
    "reach_levels": f"WITH RECURSIVE {_E}, {_GRAPH}, st AS (SELECT DISTINCT src, dst FROM g), r(id, depth) AS (SELECT v::BIGINT, 0 FROM (VALUES (1), (7)) x(v) UNION SELECT dst, depth + 1 FROM r JOIN st ON st.src = r.id WHERE depth < 4) SELECT id, min(depth) AS depth FROM r GROUP BY 1",
    "descent": f"""WITH RECURSIVE {_E}, {_SE}, d AS (SELECT * FROM se WHERE edge_type IN ('DIRECT_CALL', 'FUNCTION_POINTER_DISPATCH')), r(symbol_id, depth, seen) AS (
        SELECT min(src), 0, [min(src)] FROM se
        UNION ALL SELECT dst, depth + 1, list_append(seen, dst) FROM (SELECT d.dst, r.depth, r.seen, row_number() OVER (ORDER BY edge_type DESC, confidence DESC, is_deterministic DESC, seq) AS k FROM r JOIN d ON d.src = r.symbol_id WHERE NOT list_contains(r.seen, d.dst) AND r.depth < 15) WHERE k = 1
      ) SELECT symbol_id, depth FROM r""",
    "branch_scores": f"""WITH {_E}, {_SE}, x AS (SELECT *, regexp_extract(dst, '^(.*)::', 1) AS file FROM se WHERE edge_type IN ('DIRECT_CALL', 'MACRO_ALIAS', 'FUNCTION_POINTER_DISPATCH'))
      SELECT sha1(src || ':' || dst || ':' || edge_type) AS edge_id, round(CASE edge_type WHEN 'DIRECT_CALL' THEN 20 WHEN 'MACRO_ALIAS' THEN 10 ELSE 30 END + confidence + ({_rank("'drivers/d1.c'", 'file')}), 6) AS score FROM x""",
    "vector_topk": """WITH x AS (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q)
      SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM x) WHERE rank <= 5""",
    "token_search": """WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS token FROM benchmark), q AS (SELECT conv_id || ':' || turn AS key, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*'))) AS token FROM conversations)
      SELECT key, token FROM q WHERE token IN (SELECT token FROM w WHERE length(token) > 3) AND token NOT IN ('how', 'does', 'the', 'linux', 'what', 'where', 'why', 'a', 'an', 'is')""",
    "mode_parse": """WITH x AS (SELECT conv_id, turn, (['1-', '2-', '3-', '4-', '5-', ''])[CAST(turn % 6 + 1 AS INTEGER)] || text AS t FROM conversations)
      SELECT conv_id, turn, CASE WHEN t LIKE '1-%' THEN 'runtime_spine' WHEN t LIKE '2-%' THEN 'implementation_descent' WHEN t LIKE '3-%' THEN 'dispatch_analysis' WHEN t LIKE '4-%' THEN 'full_branch_expansion' WHEN t LIKE '5-%' THEN 'generic_entrypoint' ELSE 'runtime_spine' END AS mode, length(trim(regexp_replace(t, '^[1-5]-', ''))) AS length FROM x""",
    "profile_detect": f"""WITH x AS (SELECT doc_id, {_PROFILE_SQL} AS profile, list_filter({_DOMAIN_SQL}, lambda x: x IS NOT NULL) AS ds FROM documents)
      SELECT doc_id, profile, CASE WHEN list_contains(ds, 'interrupt_entry') THEN 'idtentry' WHEN list_contains(ds, 'interrupt') THEN 'generic_handle_irq' WHEN list_contains(ds, 'scheduler') THEN 'schedule' ELSE 'asked_fn' END AS entry, CASE WHEN len(ds) > 0 THEN array_to_string(ds, ',') ELSE 'kernel' END AS domains FROM x""",
    "concatenated_code": """WITH x AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 2 = 0 THEN 'S' ELSE 's' END || (p_partkey % 40) AS symbol, 'f' || p_size AS file, p_name AS code FROM part)
      SELECT lower(symbol) AS name, md5(string_agg(code, chr(10) ORDER BY seq)) AS code_md5, arg_min(symbol, seq) AS symbol, arg_min(file, seq) AS file, CAST(count(DISTINCT file) AS INTEGER) AS n_files, arg_max(code, seq) AS last_code, count(*) AS chunks FROM x GROUP BY 1""",
    "prompt_context": f"""WITH {_ITEMS}, {_BODY}, t AS (SELECT CAST(floor(o_orderkey / 12) AS BIGINT) AS query, o_orderkey AS k, row_number() OVER (PARTITION BY CAST(floor(o_orderkey / 12) AS BIGINT) ORDER BY o_orderkey) AS r FROM orders),
      j AS (SELECT query, left(string_agg('FILE: ' || file || chr(10) || 'SYMBOL: fn_order_' || k || chr(10) || chr(10) || left(code, 200), chr(10) || chr(10) ORDER BY r), 1500) AS prompt, count(*) AS symbols FROM t JOIN body ON l_orderkey = k WHERE r <= 8 GROUP BY 1)
      SELECT query, symbols, length(prompt) AS length, md5(prompt) AS prompt_md5 FROM j""",
    "context_expansion": f"""WITH {_P}, {_CALLS}, c AS (SELECT DISTINCT 'g_' || (call_id % 30) AS symbol, callee FROM calls WHERE callee NOT IN (SELECT symbol_name FROM s WHERE seq < 60)),
      r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY callee) AS r FROM c), h AS (SELECT symbol_name, min(file_path) AS code FROM s GROUP BY 1) SELECT symbol, callee, code FROM r JOIN h ON symbol_name = callee WHERE r <= 8""",
    "collection_bind": f"""WITH {_P}, u AS (SELECT symbol_name, arg_min(symbol_id, seq) AS symbol_id FROM s GROUP BY 1)
      SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '&' ELSE '' END || 'fn_' || (p_partkey % 130) AS name, u.symbol_id FROM part LEFT JOIN u ON u.symbol_name = 'fn_' || (p_partkey % 130)""",
    "provider_suffix": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'scheduler_class' END AS kind FROM part",
    "definition_scan": f"WITH {_ITEMS}, {_BODY} SELECT 'fn_order_' || l_orderkey AS symbol, file, md5(code) AS code_md5 FROM body",
    "vector_numbers": "SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS vec_no FROM embeddings",
    "id_bytes": f"WITH {_ITEMS} SELECT count(*) AS records, round(sum(length('call:' || file || ':' || (s + 2 * rn + 5) || ':fn_' || (l_partkey % 50)) + length('fn_' || (l_partkey % 50))) / count(*), 1) AS bytes_per_record FROM f",
    "macro_totals": f"WITH {_P}, {_ALIASES}, {_TOTALS} SELECT * FROM tt",
    "macro_report": f"""WITH {_P}, {_ALIASES}, {_PAIRS}, {_TOTALS} SELECT 0 AS section, unnest(['Total raw aliases extracted: ' || aliases, 'Unique alias names: ' || names, 'Targets resolving to known symbols: ' || known_targets, 'Targets resolving to callable symbols: ' || callable_targets]) AS line FROM tt
      UNION ALL {_section(1, 'n', 3, 'defined ')} UNION ALL {_section(2, 'in_kernel', 4, '')} UNION ALL {_section(3, 'in_drivers', 4, '')} UNION ALL {_section(4, 'in_tools', 4, '')} UNION ALL {_section(5, 'in_include', 4, '')}
      UNION ALL {_section(6, 'in_arch', 4, '')} UNION ALL {_section(7, 'in_fs', 4, '')} UNION ALL {_section(8, 'n', None, '')}""",
    "graph_build": f"""WITH {_ITEMS} SELECT DISTINCT file || '::fn_order_' || l_orderkey AS src, 'lib/leaf.c::fn_' || (l_partkey % 50) AS dst, 'DIRECT_CALL' AS edge_type, CAST(1 AS DOUBLE) AS confidence, 'drivers' AS subsystem, 'regex_call_parse' AS resolution_source FROM f
      WHERE l_partkey % 50 IN (SELECT p_partkey FROM part)
      UNION ALL SELECT '<scheduler_class_interface>::scheduler_class:pick_next_task', 'kernel/sched/' || x.f || '.c::pick_next_task_' || x.f, 'FUNCTION_POINTER_DISPATCH', 1, 'scheduler_class', 'provider' FROM (VALUES ('fair'), ('rt')) AS x(f)
      UNION ALL SELECT 'kernel/sched/core.c::__pick_next_task', '<scheduler_class_interface>::scheduler_class:pick_next_task', 'SYNTHETIC_CONTINUATION', 100, 'scheduler', 'reconstructed_execution_continuity'
      UNION ALL SELECT 'kernel/sched/' || x.f || '.c::pick_next_task_' || x.f, 'kernel/sched/core.c::context_switch', 'SYNTHETIC_CONTINUATION', 100, 'scheduler', 'reconstructed_execution_continuity' FROM (VALUES ('fair'), ('rt')) AS x(f)""",
    "graph_walk": "SELECT * FROM (VALUES (0::BIGINT, 'kernel/sched/core.c::__pick_next_task', 0), (1, '<scheduler_class_interface>::scheduler_class:pick_next_task', 1), (2, 'kernel/sched/fair.c::pick_next_task_fair', 2), (3, 'kernel/sched/core.c::context_switch', 3)) AS t(place, symbol_id, depth)",
    "dispatch_trace": f"""WITH RECURSIVE {_E}, {_SE}, d AS (SELECT * FROM se WHERE edge_type IN ('DIRECT_CALL', 'FUNCTION_POINTER_DISPATCH')), r(symbol_id, depth, seen) AS (
        SELECT min(src), 0, [min(src)] FROM se
        UNION ALL SELECT dst, depth + 1, list_append(seen, dst) FROM (SELECT d.dst, r.depth, r.seen, row_number() OVER (ORDER BY edge_type DESC, confidence DESC, is_deterministic DESC, seq) AS k FROM r JOIN d ON d.src = r.symbol_id WHERE NOT list_contains(r.seen, d.dst) AND r.depth < 15) WHERE k = 1
      ) SELECT symbol_id, depth FROM r""",
    "provider_nested": f"""WITH x AS (SELECT {_K} AS k, (['kernel/sched/fair.c', 'kernel/sched/rt.c', 'kernel/sched/idle.c', 'kernel/sched/deadline.c'])[CAST(p_partkey % 4 + 1 AS INTEGER)] AS file FROM part)
      SELECT 'scheduler_class' AS kind, CASE WHEN t.macro THEN 'm' || k || '_sched_class' ELSE 's' || k END AS provider, file, t.op, t.func || CASE WHEN t.numbered THEN k ELSE '' END AS func
      FROM x, (VALUES (true, 'pick_task', 'pick_', true), (true, 'enqueue_task', 'enq', false), (false, 'yield_task', 'y_', true), (false, 'dequeue_task', 'deq', false)) AS t(macro, op, func, numbered)""",
    "initializer_chunks": f"""WITH x AS (SELECT 'kernel/f' || {_K} || '.c' AS file, ' /* ' || {_K} || ' */' AS n FROM part), c AS (
      SELECT file, 'b' AS v, 6 AS a, 8 AS z, 'const struct sched_class b_sched_class = {{' || n || chr(10) || chr(9) || '.x = {{ 1 }},' || n || chr(10) || '}};' || n AS code FROM x
      UNION ALL SELECT file, 'c', 9, 9, 'struct sched_class c_sched_class = {{ }};' || n FROM x
      UNION ALL SELECT file, 'd', 10, 13, 'struct sched_class d_sched_class =' || n || chr(10) || '{{' || n || chr(10) || chr(9) || '.y = 2' || n || chr(10) || '}};' || n FROM x
      UNION ALL SELECT file, 'e', 14, 14, 'struct sched_class e_sched_class = base;' || n FROM x
    ) SELECT 'var:' || file || ':' || v || '_sched_class' AS symbol_id, a AS start_line, z AS end_line, md5(code) AS code_md5 FROM c""",
    "edge_mermaid": f"""WITH {_E}, {_SE} SELECT -1 AS place, 'graph TD' AS line UNION ALL SELECT seq, '    ' || regexp_extract(src, '::(.*)$', 1) || CASE edge_type WHEN 'MACRO_ALIAS' THEN '-. MACRO_ALIAS .->' WHEN 'FUNCTION_POINTER_DISPATCH' THEN '== FUNCTION_POINTER_DISPATCH ==>' ELSE '-- ' || edge_type || ' -->' END || regexp_extract(dst, '::(.*)$', 1) FROM se""",
    "trace_print": f"""WITH {_E}, x AS (SELECT src, seq - src * 1000 AS k, dst, kind, seq, max(seq - src * 1000) OVER (PARTITION BY src) AS n FROM e)
      SELECT CAST(k AS INTEGER) AS depth, seq AS node, 0 AS part, '[Depth=' || k || '] n' || src || ':' || k AS line FROM x
      UNION ALL SELECT CAST(k AS INTEGER), seq, 1, '    ├── [STATE_MUTATION] ' || src || ':x' || dst FROM x
      UNION ALL SELECT CAST(k AS INTEGER), seq, 2, '    └── ➔ [' || kind || '] ' || CASE WHEN k < n THEN 'n' ELSE '' END || src || ':' || (k + 1) FROM x""",
    "chunk_index": "SELECT event_id, 'f' || (user_id % 20) || '.c' AS file, CASE WHEN event_id % 2 = 0 THEN 'content' || event_id WHEN event_id % 3 = 0 THEN 'source' || event_id WHEN event_id % 5 = 0 THEN 'code' || event_id END AS code, CAST(NULL AS VARCHAR) AS symbol_id, 1 AS start_line FROM events",
    "graph_json": f"""WITH {_P}, {_E}, g AS (SELECT src, string_agg('{{"seq":' || seq || ',"dst":"' || dst || '","edge_type":"' || kind || '","confidence":' || confidence || '}}', ',' ORDER BY seq) AS es FROM e GROUP BY 1),
      v AS (SELECT '{{"symbol_id":"' || seq || '","file_path":"' || file_path || '","symbol_name":"' || symbol_name || '","subsystem":"net"' || coalesce(',"edges":[' || es || ']', '') || '}}' AS value FROM s LEFT JOIN g ON g.src = s.seq) SELECT md5(value) AS md5, length(value) AS length FROM v""",
    "name_keys": f"WITH {_P} SELECT symbol_name, string_agg(symbol_id, ',' ORDER BY file_path) AS keys FROM s GROUP BY 1",
    "edge_dump": f"WITH {_E}, {_SE} SELECT dst, edge_type, confidence FROM se WHERE src = 'drivers/d1.c::fn_1'",
    "fact_lines": f"WITH {_ITEMS}, {_FACTS} SELECT symbol_id, printf('%5d', l) || ' ' || CASE WHEN length(domain) < 14 THEN rpad(domain, 14, ' ') ELSE domain END || ' ' || id AS report FROM x",
    "symbol_lines": f"""WITH {_ITEMS} SELECT symbol_id, lpad(CAST(s + d.declaration_line - 1 AS VARCHAR), 5, ' ') || ' ' || rpad(d.storage, 9, ' ') || ' ' || d.type_name || ' ' || d.stars || d.name AS report FROM o,
      (VALUES ('o', 'parameter', 'order', '*', 1), ('cpu', 'parameter', 'int', '', 1), ('it', 'local', 'line_item', '*', 3), ('total', 'local', 'int', '', 4)) AS d(name, storage, type_name, stars, declaration_line)""",
    "symbol_search": f"WITH {_P} SELECT symbol_id, symbol_name FROM s WHERE symbol_name LIKE '%n\\_1%' ESCAPE '\\'",
    "candidate_order": f"WITH {_P} SELECT symbol_id, CAST(row_number() OVER (ORDER BY file_path) AS INTEGER) AS place FROM s WHERE symbol_name = 'fn_7'",
    "rcu_warnings": """SELECT 'func:a.c:r_' || o_orderkey AS symbol_id, 'a.c:4: rcu_dereference of unresolved target g_' || o_orderkey AS warning FROM orders UNION ALL SELECT 'func:a.c:r_' || o_orderkey, 'a.c:5: rcu_assign_pointer of unresolved target other' FROM orders""",
    "ext_every_primitive": f"SELECT t.domain, t.fact_type, t.what, t.kind, CAST(t.line AS INTEGER) AS line, (SELECT count(*) FROM orders) AS n FROM (VALUES {_EVERY_SQL}) AS t(domain, fact_type, what, kind, line)",
}

ORACLE_SQL["collection_lines"] = f"SELECT name || ': ' || family || ' (' || declaration_macro || ') in ' || declaration_file AS report FROM ({ORACLE_SQL['ext_collections']})"
_RELATED = " UNION ALL ".join(f"SELECT '{kind}' AS edge_kind, source_semantic_id AS s, target_semantic_id AS t FROM ({ORACLE_SQL[f'rel_{kind}']})" for kind in ("writes", "matches", "protects"))
ORACLE_SQL["store_edges"] = f"WITH r AS ({_RELATED}) SELECT edge_kind, count(DISTINCT (s, t)) AS n, count(DISTINCT s) AS sources, count(DISTINCT t) AS targets FROM r GROUP BY 1"
