"""Kinds, id prefixes and table schemas (as DDL) of the architecture graph."""

from __future__ import annotations


# Kinds, prefixes and domains that answers and ids are spelled with.
NODE_KINDS = frozenset(
    "service lib nats-subject rmq-pattern db-table queue module provider file external fe-page fe-component fe-route fe-hook "
    "endpoint config-field scoped-marker db-entity-field doc-section cron-schedule".split()
)
DOMAINS = {
    "nats": "nats-publish nats-request nats-subscribe nats-reply",
    "rmq": "rmq-subscribe",
    "http": "http-call http-external",
    "bullmq": "queue-produce queue-consume queue-fails-into queue-event-listener queue-repeat",
    "typeorm": "db-read db-write db-access db-relation",
    "di": "di-import di-provides di-exports di-controller di-uses di-guard di-interceptor di-pipe",
    "imports": "ts-import lib-usage",
    "fe": "fe-imports fe-renders fe-routes-to",
    "endpoint": "endpoint-of endpoint-calls",
    "config": "config-read-by",
    "entity-fields": "entity-has-field",
    "scoped": "scoped",
    "cron": "cron-triggers",
}
DOMAIN_OF = {kind: domain for domain, kinds in DOMAINS.items() for kind in kinds.split()}
EDGE_KINDS = frozenset(DOMAIN_OF)
#: Prefixes that names may be given without; others are part of the name.
STRIPPED = ("service", "lib", "nats", "db-table", "queue", "module", "provider", "external", "file")
SENDERS = ("nats-publish", "nats-request")
RECEIVERS = ("nats-subscribe", "nats-reply")
#: Edge kinds among which import cycles are looked for.
CYCLE_KINDS = ("ts-import", "lib-usage", "di-import")
#: Order in which the parts of a graph are merged.
PART_ORDER = ("nats", "rmq", "typeorm", "bullmq", "cron", "di", "http", "imports", "fe", "endpoint", "config", "entity-fields")


NODES = "id string, kind string, label string, path string, anchor string, meta string, ord long"
EDGES = "id string, src string, dst string, kind string, dynamic boolean, subject_pattern string, file string, line int, meta string, ord long"
RECORDS = "node_id string, kind string, label string, path string, snippet string, content_hash string, vector array<float>, ord long"
TRUTH = "domain string, role string, file string, line int, column int, matched_text string, context string"
SYMBOLS = (
    "id string, kind string, name string, fqn string, file string, line int, column int, end_line int, parent_id string, owner_name string, signature string, "
    "type string, return_type string, visibility string, is_async boolean, decorators array<string>, description string, quality_score double, "
    "extends_class string, extends_type_args array<string>, inherits_from string, override_kind string"
)
CALLS = (
    "id string, caller_id string, caller string, callee string, callee_id string, kind string, module string, import_name string, order int, "
    "expression string, receiver string, args array<string>, conditions array<string>, file string, line int, column int"
)
FLOWS = (
    "id string, target_id string, target string, param string, source_kind string, source string, via string, to string, to_param string, "
    "sink_kind string, path array<string>, file string, line int, column int"
)
BRANCHES = "id string, function_id string, function_name string, condition string, then_text string, nested_in array<string>, calls array<string>, file string, line int, column int"
IMPACTS = "id string, symbol_id string, symbol string, field string, kind string, detail string, risk string, file string, line int, column int"
POLICIES = "id string, kind string, rule string, description string, confidence double, count int, total int"
