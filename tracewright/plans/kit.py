"""What the engine knows about kernel C: primitives, macros, patterns and subsystem profiles.

All names, patterns and weights in this module are fixed values of the analysed dialect.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

# --- fixed values: text patterns -------------------------------------------------------------
CALL = r"\b([a-zA-Z_]\w*)\s*\(([^;]*)\)"
PLAIN_CALL = r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\("
MUTATION = r"\b([a-zA-Z_][a-zA-Z0-9_\->.]*(?:\s*\[[^\]]+\])?)\s*(=|\+=|-=|\*=|/=|\|=|&=|\^=|\+\+|--)(?!=)([^;\n]*);?"
DECLARATION = r"^\s*((?:(?:static|const|struct|union|enum|unsigned|signed|long|short|volatile)\s+)*[a-zA-Z_]\w*)\s+([*a-zA-Z_][^;]*);\s*$"
PARAMETERS = r"\(([^)]*)\)\s*\{?"
IDENTIFIER = r"[a-zA-Z_]\w*"
MACRO_ALIAS = r"(?m)^#define\s+(\w+)\([^)]*\)\s*\(?\s*(\w+)\("
COMMENT = r"(?s)/\*.*?\*/|//[^\n]*"
COMMENT_TO_END = r"(?s)/\*.*?\*/|//.*"

# --- fixed values: names ---------------------------------------------------------------------
CONTROL = ("if", "for", "while", "switch", "return", "sizeof")
RESERVED = ("return", "goto", "if", "else", "while", "for", "switch", "case", "break", "continue", "sizeof")
BUILTIN_TYPES = ("int", "char", "void", "long", "short", "float", "double", "unsigned", "signed")
QUALIFIERS = ("const", "volatile", "restrict")
NOISE_PATHS = ("tools/", "samples/", "Documentation/")
#: primitive -> saves the interrupt state
ACQUIRE = {"spin_lock": False, "raw_spin_lock": False, "mutex_lock": False, "spin_lock_irqsave": True, "rq_lock": False}
#: primitive -> restores the interrupt state
RELEASE = {"spin_unlock": False, "raw_spin_unlock": False, "mutex_unlock": False, "spin_unlock_irqrestore": True, "raw_spin_rq_unlock_irq": True}
INTERRUPT = {"local_irq_disable": "disable", "raw_local_irq_disable": "disable", "local_irq_enable": "enable", "raw_local_irq_enable": "enable"}
#: macro -> (cursor position, collection position, family)
ITERATORS = {
    "list_for_each_entry": (0, 1, "list"),
    "hlist_for_each_entry": (0, 1, "hlist"),
    "list_for_each_entry_safe": (0, 2, "list"),
    "hlist_for_each_entry_safe": (0, 2, "hlist"),
    "list_for_each_entry_rcu": (0, 1, "list"),
    "hlist_bl_for_each_entry_rcu": (0, 2, "hlist_bl"),
    "hash_for_each": (3, 0, "hash"),
    "hash_for_each_rcu": (3, 0, "hash"),
    "rbtree_postorder_for_each_entry_safe": (0, 2, "rbtree"),
}
#: role -> API names; the first role that has a name wins
RCU = {
    "read_lock": ("rcu_read_lock", "srcu_read_lock", "rcu_read_lock_bh", "rcu_read_lock_sched"),
    "read_unlock": ("rcu_read_unlock", "srcu_read_unlock", "rcu_read_unlock_bh", "rcu_read_unlock_sched"),
    "deref": ("rcu_dereference", "rcu_access_pointer", "rcu_dereference_bh", "rcu_dereference_sched", "rcu_dereference_raw", "rcu_dereference_check"),
    "publish": ("rcu_assign_pointer", "RCU_INIT_POINTER"),
    "grace_period": ("synchronize_rcu", "synchronize_rcu_bh", "synchronize_sched", "call_rcu", "kfree_rcu"),
    "loop": ("hlist_for_each_entry_rcu", "hlist_bl_for_each_entry_rcu", "list_for_each_entry_rcu", "list_for_each_entry_continue_rcu", "hlist_for_each_entry_rcu_bh"),
}
#: (pattern, family, type, macro)
COLLECTIONS = (
    (r"\bLIST_HEAD\s*\(\s*([A-Za-z0-9_]+)\s*\)", "linked_list", "struct list_head", "LIST_HEAD"),
    (r"\bDECLARE_HASHTABLE\s*\(\s*([A-Za-z0-9_]+)\s*,", "hash_table", "DECLARE_HASHTABLE", "DECLARE_HASHTABLE"),
    (r"\bDEFINE_XARRAY(?:_FLAGS|_ALLOC)?\s*\(\s*([A-Za-z0-9_]+)\s*\)", "xarray", "struct xarray", "DEFINE_XARRAY"),
    (r"\bDEFINE_IDR\s*\(\s*([A-Za-z0-9_]+)\s*\)", "idr", "struct idr", "DEFINE_IDR"),
    (r"\bDECLARE_BITMAP\s*\(\s*([A-Za-z0-9_]+)\s*,", "bitmap", "unsigned long[]", "DECLARE_BITMAP"),
)
#: calls that the inter-function graph leaves out
IGNORED_CALLS = (
    "if", "for", "while", "switch", "return", "sizeof", "__acquires", "__releases", "__must_check", "__always_inline", "__maybe_unused", "__sched",
    "likely", "unlikely", "WARN_ON", "BUG_ON", "container_of", "READ_ONCE", "WRITE_ONCE", "TEST",
    "SYSCALL_DEFINE", "SYSCALL_DEFINE0", "SYSCALL_DEFINE1", "SYSCALL_DEFINE2", "SYSCALL_DEFINE3", "SYSCALL_DEFINE4", "SYSCALL_DEFINE5", "SYSCALL_DEFINE6",
    "module_init", "module_exit", "DEFINE_INTERRUPT_HANDLER", "DECLARE_INTERRUPT_HANDLER", "DEFINE_IDTENTRY", "DECLARE_IDTENTRY", "DEFINE_IDTENTRY_RAW",
)
NON_EXECUTION = (
    "dev_err", "dev_dbg", "dev_info", "dev_warn", "pr_err", "pr_warn", "pr_info", "pr_debug", "IS_ERR", "PTR_ERR", "ARRAY_SIZE",
    "BIT", "FIELD_PREP", "FIELD_GET", "le16_to_cpu", "cpu_to_le16", "le32_to_cpu", "cpu_to_le32", "WARN_ON", "WARN_ON_ONCE", "netdev_priv", "dev_get_drvdata",
)
MMIO = ("readl", "writel", "readb", "writeb", "readw", "writew")
STOP_WORDS = ("how", "does", "the", "linux", "what", "where", "why", "a", "an", "is")
SUBSYSTEMS = (("kernel/sched", "scheduler"), ("kernel/irq", "interrupts"), ("kernel/softirq", "softirq"), ("fs", "vfs"), ("mm", "memory_management"), ("block", "block_layer"), ("net", "networking"), ("drivers", "drivers"))
EDGE_TYPES = ("DIRECT_CALL", "FUNCTION_POINTER_DISPATCH", "SYNTHETIC_CONTINUATION", "ASYNC_WAKEUP", "INTERRUPT_ENTRY", "INTERRUPT_EXIT", "STATE_MUTATION", "LOCK_ACQUIRE", "LOCK_RELEASE", "WORKQUEUE_QUEUE", "WORKQUEUE_EXECUTE", "MACRO_ALIAS")
TRAVERSABLE = ("DIRECT_CALL", "FUNCTION_POINTER_DISPATCH", "SYNTHETIC_CONTINUATION", "ASYNC_WAKEUP", "INTERRUPT_ENTRY", "INTERRUPT_EXIT", "WORKQUEUE_EXECUTE")
PRIORITY = {"SYNTHETIC_CONTINUATION": 4, "FUNCTION_POINTER_DISPATCH": 3, "DIRECT_CALL": 2, "MACRO_ALIAS": 1}
PRINT_NOISE = ("printk", "pr_info", "pr_warn", "pr_debug", "fprintf", "vfprintf", "sprintf", "snprintf", "seq_printf", "printf", "scnprintf")
UTILITY_NOISE = ("strlen", "strcmp", "strncmp", "memcmp", "memcpy", "memset")
SYNC_NOISE = ("mutex_lock", "mutex_unlock", "spin_lock", "spin_unlock", "mutex_init")
DOMAINS = ("Synchronization", "Assignment", "State", "Dispatch", "RCU", "Call", "Iteration")
WRAPPERS_ACPI = ("ACPI_EXPORT_SYMBOL", "ACPI_EXPORT_SYMBOL_INIT")
WRAPPERS_BPF = ("BPF_KSYSCALL", "BPF_PROG")
WRAPPERS_MODULE = ("module_init", "module_exit", "device_initcall")
MODES = {"1-": "runtime_spine", "2-": "implementation_descent", "3-": "dispatch_analysis", "4-": "full_branch_expansion", "5-": "generic_entrypoint"}
#: the first profile with a keyword in the query wins
PROFILE_KEYWORDS = (
    ("sched", ("sched", "scheduler", "task", "context switch", "runqueue")),
    ("vfs", ("vfs", "file", "filesystem", "read", "write", "inode", "dentry")),
    ("irq", ("irq", "interrupt", "softirq", "hardirq")),
    ("net", ("net", "network", "tcp", "udp", "socket", "skb", "packet")),
    ("block", ("block", "bio", "request", "nvme", "disk", "storage")),
    ("mm", ("mm", "memory", "page", "fault", "allocation", "allocator", "slab", "folio")),
    ("workqueue", ("workqueue",)),
)
# --- end of fixed values ---------------------------------------------------------------------


#: The matches of MUTATION, found without giving names back letter by letter: what comes after a name begins with none of
#: its letters but the dash.
MUTATION_SEARCH = r"\b(?!\d)(\w[\w>.]*+(?:-[\w>.]*+)*(?:\s*+\[[^\]]++\])?+)\s*+([-+*/|&^]?+=|\+\+|--)(?!=)([^;\n]*+);?+"
#: Between the groups of a match that are kept in one column.
GROUPS = "\u0002"


@dataclass(frozen=True)
class Kit:
    """A dialect: the names and patterns that the extractors go by. Another dialect is another Kit."""

    name: str
    acquire: dict[str, bool]
    release: dict[str, bool]
    interrupt: dict[str, str]
    iterators: dict[str, tuple[int, int, str]]
    rcu: dict[str, tuple[str, ...]]
    control: tuple[str, ...] = CONTROL
    call: str = CALL
    mutation: str = MUTATION_SEARCH

    def call_exclusions(self) -> list[str]:
        """Names that are no calls: control words, iterators, and the lock, interrupt and RCU primitives."""
        return sorted({*self.control, *self.iterators, *self.acquire, *self.release, *self.interrupt, *(x for names in self.rcu.values() for x in names)})


LINUX = Kit("linux", ACQUIRE, RELEASE, INTERRUPT, ITERATORS, RCU)


def _branches(names: list[str]) -> str:
    """The names, equal beginnings once."""
    out = []
    for first in sorted({n[:1] for n in names} - {""}):
        own = [n for n in names if n[:1] == first]
        head = os.path.commonprefix(own)
        out.append(re.escape(head) + _branches([n[len(head) :] for n in own]))
    optional = "?" if "" in names else ""
    return out[0] if len(out) == 1 and not optional else f"(?:{'|'.join(out)}){optional}" if out else ""


def any_of(names) -> str:
    """Uses of the names, at word boundaries, with their arguments. A name is told by what follows it, so the order of the names does not matter."""
    names = sorted(set(names))
    first = "".join(sorted({re.escape(n[0]) for n in names}))
    return rf"\b(?=[{first}])({_branches(names)})\s*+\(([^;]*)\)"


@dataclass(frozen=True)
class ProviderPattern:
    suffix: str
    kind: str
    struct: str
    macro: str = ""


@dataclass(frozen=True)
class Profile:
    """Weights and bounds of traces through one subsystem."""

    name: str
    entrypoints: tuple[str, ...] = ()
    entrypoint_files: tuple[str, ...] = ()
    low_signal: tuple[str, ...] = ()
    boost: dict[str, float] = field(default_factory=dict)
    transitions: dict[tuple[str, str], float] = field(default_factory=dict)
    bridges: dict[str, str] = field(default_factory=dict)
    provider_files: tuple[str, ...] = ()
    providers: tuple[ProviderPattern, ...] = ()
    operations: tuple[str, ...] = ()
    depth_limit: int | None = 16
    terminals: tuple[str, ...] = ()
