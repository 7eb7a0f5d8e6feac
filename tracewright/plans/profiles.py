"""Subsystem profiles. Names, weights and limits are fixed values of the analysed dialect."""

from __future__ import annotations

from .kit import PROFILE_KEYWORDS, Profile, ProviderPattern


def _pairs(weight: float, *pairs: tuple[str, str]) -> dict[tuple[str, str], float]:
    return dict.fromkeys(pairs, weight)


SCHED = Profile(
    name="kernel/sched",
    entrypoints=("schedule", "try_to_wake_up", "wake_up_process"),
    entrypoint_files=("kernel/sched/core.c",),
    low_signal=("lockdep_assert", "task_is_running", "schedstat_inc", "trace_sched_switch", "rcu_note_context_switch", "might_sleep", "preempt_disable", "preempt_enable", "WARN_ON"),
    boost=dict.fromkeys(("schedule", "__schedule", "pick_next_task", "__pick_next_task", "context_switch", "__switch_to", "finish_task_switch", "__schedule_loop"), 10.0),
    transitions=_pairs(20.0, ("schedule", "__schedule"), ("__schedule", "pick_next_task"), ("pick_next_task", "__pick_next_task"), ("context_switch", "__switch_to"), ("__switch_to", "finish_task_switch"), ("schedule", "__schedule_loop"), ("__schedule_loop", "__schedule")),
    bridges={"__pick_next_task": "scheduler_class:pick_next_task", "pick_next_task_fair": "context_switch", "pick_next_task_rt": "context_switch", "pick_next_task_idle": "context_switch", "context_switch": "__switch_to", "__switch_to": "finish_task_switch"},
    provider_files=("kernel/sched/fair.c", "kernel/sched/rt.c", "kernel/sched/idle.c", "kernel/sched/deadline.c"),
    providers=(ProviderPattern("_sched_class", "scheduler_class", "sched_class", "DEFINE_SCHED_CLASS"),),
    operations=("pick_next_task", "pick_task", "enqueue_task", "dequeue_task", "check_preempt_curr", "yield_task", "wakeup_preempt"),
    depth_limit=16,
    terminals=("__switch_to", "finish_task_switch"),
)
VFS = Profile(
    name="kernel/fs",
    entrypoints=("vfs_read", "vfs_write", "do_sys_open"),
    entrypoint_files=("fs/read_write.c",),
    low_signal=("might_fault", "fsnotify_access", "fsnotify_modify", "rw_verify_area", "file_start_write", "file_end_write", "WARN_ON", "BUG_ON"),
    boost={"vfs_read": 10.0, "new_sync_read": 20.0},
    transitions=_pairs(20.0, ("vfs_read", "vfs_readf"), ("vfs_write", "vfs_writef")),
    bridges={"new_sync_read": "file_operations:read_iter"},
    provider_files=("fs/ext4/file.c", "fs/read_write.c", "fs/open.c"),
    providers=(ProviderPattern("_fops", "file_operations", "file_operations", "DEFINE_FILE_OPERATIONS"),),
    operations=("read", "write", "read_iter", "write_iter", "open", "release", "mmap", "fsync", "iterate_shared"),
    depth_limit=12,
    terminals=("generic_file_read_iter", "filemap_read"),
)
MM = Profile(
    name="mm",
    entrypoints=("handle_mm_fault", "do_page_fault", "__alloc_pages"),
    entrypoint_files=("mm/memory.c",),
    low_signal=("page_get", "put_page", "folio_get", "folio_put", "SetPageDirty", "WARN_ON_ONCE", "pte_unmap_unlock", "rcu_read_lock", "rcu_read_unlock"),
    boost=dict.fromkeys(("handle_mm_fault", "__handle_mm_fault", "handle_pte_fault", "do_anonymous_page", "do_fault", "do_swap_page", "__alloc_pages", "get_page_from_freelist"), 10.0),
    transitions=_pairs(20.0, ("handle_mm_fault", "__handle_mm_fault"), ("__handle_mm_fault", "handle_pte_fault"), ("handle_pte_fault", "do_pte_missing"), ("do_pte_missing", "do_anonymous_page"), ("__alloc_pages", "get_page_from_freelist")) | {("do_pte_missing", "do_fault"): 30.0},
    bridges={"do_fault": "vm_operations:fault", "do_page_mkwrite": "vm_operations:page_mkwrite"},
    provider_files=("mm/memory.c", "mm/filemap.c", "mm/shmem.c", "mm/huge_memory.c"),
    providers=(ProviderPattern("_vm_ops", "vm_operations", "vm_operations_struct"),),
    operations=("fault", "page_mkwrite", "map_pages", "pfn_mkwrite"),
    depth_limit=16,
    terminals=("filemap_fault", "shmem_fault", "do_swap_page", "do_anonymous_page"),
)
NET = Profile(
    name="net",
    entrypoints=("netif_receive_skb", "dev_queue_xmit", "napi_poll", "tcp_v4_rcv"),
    low_signal=("skb_get", "kfree_skb", "consume_skb", "rcu_read_lock", "rcu_read_unlock", "local_bh_disable", "local_bh_enable", "skb_reserve"),
    boost=dict.fromkeys(("netif_receive_skb", "__netif_receive_skb", "__netif_receive_skb_core", "ip_rcv", "ip_local_deliver", "tcp_v4_rcv", "dev_queue_xmit", "__dev_queue_xmit", "napi_poll", "__napi_poll"), 10.0),
    transitions=_pairs(20.0, ("netif_receive_skb", "__netif_receive_skb"), ("__netif_receive_skb", "__netif_receive_skb_core"), ("dev_queue_xmit", "__dev_queue_xmit"), ("napi_poll", "__napi_poll")) | {("ip_local_deliver", "tcp_v4_rcv"): 15.0},
    bridges={"__napi_poll": "napi_struct:poll", "__dev_queue_xmit": "net_device_ops:ndo_start_xmit", "sk_prot_recvmsg": "proto:recvmsg"},
    provider_files=("net/core/dev.c", "net/ipv4/tcp_ipv4.c", "net/ipv4/ip_input.c", "net/ipv4/ip_output.c"),
    providers=(ProviderPattern("_netdev_ops", "net_device_ops", "net_device_ops"), ProviderPattern("_prot", "socket_protocol", "proto")),
    operations=("ndo_start_xmit", "poll", "recvmsg", "sendmsg", "handler"),
    depth_limit=20,
)
BLOCK = Profile(
    name="block",
    entrypoints=("submit_bio", "blk_mq_submit_bio", "blk_mq_dispatch_rq_list"),
    entrypoint_files=("block/blk-core.c",),
    low_signal=("should_fail_bio", "should_fail_request", "should_fail", "should_fail_ex", "fail_stacktrace"),
    boost=dict.fromkeys(("submit_bio", "submit_bio_noacct", "submit_bio_noacct_nocheck", "blk_mq_submit_bio"), 10.0),
    transitions=_pairs(20.0, ("submit_bio", "submit_bio_noacct"), ("submit_bio_noacct", "submit_bio_noacct_nocheck"), ("submit_bio_noacct_nocheck", "__submit_bio_noacct"), ("__submit_bio_noacct", "__submit_bio"), ("__submit_bio", "blk_mq_submit_bio")),
    bridges={"__blk_mq_issue_directly": "blk_mq_ops:queue_rq", "blk_mq_dispatch_rq_list": "blk_mq_ops:queue_rq"},
    provider_files=("block/blk-core.c", "block/blk-mq.c", "block/blk-mq-sched.c"),
    providers=(ProviderPattern("_mq_ops", "blk_mq_ops", "blk_mq_ops"),),
    operations=("queue_rq", "commit_rqs", "complete"),
    depth_limit=16,
    terminals=("bio_endio", "blk_mq_end_request"),
)
IRQ = Profile(
    name="kernel/irq",
    entrypoints=("handle_irq_event", "__do_softirq", "irq_exit"),
    entrypoint_files=("kernel/irq/handle.c",),
    low_signal=("irq_state_set", "irqd_irq_disabled", "local_irq_enable", "local_irq_disable", "rcu_irq_enter", "rcu_irq_exit"),
    boost=dict.fromkeys(("handle_irq_event", "handle_irq_event_percpu", "__handle_irq_event_percpu", "do_softirq", "__do_softirq", "irq_exit", "irq_exit_rcu"), 10.0),
    transitions=_pairs(20.0, ("handle_irq_event", "handle_irq_event_percpu"), ("handle_irq_event_percpu", "__handle_irq_event_percpu"), ("irq_exit", "irq_exit_rcu")) | {("irq_exit_rcu", "__do_softirq"): 15.0},
    bridges={"__handle_irq_event_percpu": "irqaction:handler", "__do_softirq": "softirq_action:action", "mask_irq": "irq_chip:irq_mask", "unmask_irq": "irq_chip:irq_unmask", "ack_irq": "irq_chip:irq_ack"},
    provider_files=("kernel/irq/handle.c", "kernel/irq/chip.c", "kernel/softirq.c", "kernel/irq/spurious.c"),
    providers=(ProviderPattern("_chip", "irq_chip", "irq_chip"), ProviderPattern("_action", "irqaction", "irqaction")),
    operations=("handler", "action", "irq_mask", "irq_unmask", "irq_ack", "irq_eoi"),
    depth_limit=14,
)
WORKQUEUE = Profile(
    name="kernel/workqueue",
    entrypoints=("queue_work_on", "worker_thread"),
    entrypoint_files=("kernel/workqueue.c",),
    low_signal=("local_irq_save", "local_irq_restore", "spin_lock_irq", "spin_unlock_irq", "lock_map_acquire", "lock_map_release", "debug_work_activate", "debug_object_activate", "debug_objects_fill_pool", "pool_should_refill", "pool_count"),
    boost=dict.fromkeys(("queue_work", "queue_work_on", "__queue_work", "insert_work", "worker_thread", "process_one_work", "process_scheduled_works"), 10.0),
    transitions=_pairs(20.0, ("insert_work", "set_work_pwq"), ("queue_work", "queue_work_on"), ("queue_work_on", "__queue_work"), ("__queue_work", "insert_work"), ("worker_thread", "process_one_work"), ("worker_thread", "process_scheduled_works"), ("process_scheduled_works", "process_one_work")),
    bridges={"process_one_work": "work_struct:func"},
    provider_files=("kernel/workqueue.c",),
    providers=(ProviderPattern("", "work_func", "work_struct", "INIT_WORK"),),
    operations=("func",),
    depth_limit=12,
    terminals=("work_struct:func",),
)
GENERIC = Profile(name="generic", depth_limit=16)

PROFILES = {"sched": SCHED, "vfs": VFS, "irq": IRQ, "net": NET, "block": BLOCK, "mm": MM, "workqueue": WORKQUEUE, "generic": GENERIC}


def detect(query: str) -> str | None:
    """The profile's key for a query, by substrings in fixed order; none for no keyword."""
    q = query.lower()
    return "generic" if q.startswith("5-") else next((key for key, words in PROFILE_KEYWORDS if any(w in q for w in words)), None)


def register(key: str, profile: Profile) -> None:
    """Make a profile known by a key, in place of one of that key."""
    PROFILES[key] = profile


def get(key: str) -> Profile:
    """The profile of a key; an unknown one is an error that names those known."""
    if key not in PROFILES:
        raise KeyError(f"no profile {key!r}; known are {sorted(PROFILES)}")
    return PROFILES[key]
