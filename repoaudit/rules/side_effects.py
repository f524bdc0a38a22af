"""Distributed side effect rules. Fixed values."""

from __future__ import annotations

from repoaudit.functions.regex import bank

WINDOW_LINES = 40
WINDOW_STEP = 10

COMMIT = bank(
    r"\b(?:session|db|uow|unit_of_work|transaction|txn)\.commit\s*\(",
    r"\bcommit\s*\(",
    r"\b(?:save_changes|flush)\s*\(",
    ignore_case=True,
)
EFFECT = bank(
    r"\b(?:publish|emit|produce|send|enqueue|dispatch|append_to_stream|notify)\s*\(",
    r"\b(?:requests|httpx|axios)\.(?:post|put|patch|delete)\s*\(",
    r"\bfetch\s*\(",
    r"\b(?:webhook|sns|sqs|kafka|rabbit|pubsub|nats|celery)\b",
    r"\b(?:charge|capture|refund|ship|deliver|post_message)\s*\(",
    ignore_case=True,
)
OUTBOX = bank(
    r"\boutbox\b", r"\bevent_outbox\b", r"\bpending_events\b", r"\bcdc\b", r"\bdebezium\b", r"\brelay\b",
    ignore_case=True,
)
IDEMPOTENCY = bank(
    r"\bidempoten", r"\bdedup", r"\bde[-_ ]?dupe\b", r"\bprocessed_messages?\b", r"\bmessage_id\b", r"\bevent_id\b",
    r"\brequest_id\b", r"\bidempotency[_-]?key\b", r"\bON CONFLICT\b", r"\bUPSERT\b", r"\bunique\b",
    ignore_case=True,
)
RETRY = bank(r"@retry", r"\bretry\s*\(", r"\btenacity\b", r"\bbackoff\b", ignore_case=True)
DEAD_LETTER = bank(r"\bdlq\b", r"dead[-_ ]?letter", r"poison[-_ ]?queue", ignore_case=True)
EVENT_VERSION = bank(
    r"\bevent_version\b", r"\bversion\s*[:=]", r'"version"\s*:', r"\bv[0-9]+\b", ignore_case=True
)
OBSERVABILITY = bank(
    r"\btrace_id\b", r"\bcorrelation_id\b", r"\bspan\b", r"\bmetric\b", r"\blogger\b", r"\bopentelemetry\b",
    ignore_case=True,
)
CONSUMER = bank(
    r"\bconsumer\b", r"\bsubscriber\b", r"\bhandler\b", r"\blistener\b", r"\bwebhook\b", r"\bon_message\b",
    r"\bon_event\b", r"\bprocess_",
    ignore_case=True,
)
MUTATION = bank(r"\b(?:commit|save|insert|update|delete|upsert|write)\b", ignore_case=True)
RELEVANT_WORDS = ["webhook", "queue", "event"]
CONSUMER_PATH_WORDS = ["consumer", "handler", "listener", "subscriber", "webhook"]

FLAG_BANKS = {
    "outbox": OUTBOX,
    "idempotency": IDEMPOTENCY,
    "dead_letter": DEAD_LETTER,
    "event_versioning": EVENT_VERSION,
    "observability": OBSERVABILITY,
}

TITLES = {
    "pre-commit-side-effect": "External side effect appears before durable local commit",
    "dual-write-hazard": "Database write and external side effect happen in the same flow",
    "outbox-gap": "No visible outbox / relay signal near a dual-write path",
    "unsafe-retry": "Retry logic wraps a likely side-effect path without visible idempotency clues",
    "idempotency-gap": "Consumer / handler mutates state without visible idempotency guard",
    "dead-letter-gap": "No visible dead-letter / poison handling signal in a repo with async side effects",
    "event-contract-gap": "No clear event versioning signal was detected",
    "observability-gap": "No clear correlation / trace signal was detected around distributed side effects",
}
