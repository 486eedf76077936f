"""Registered queries over the driver tables, with their SQL counterparts."""

from callgrain.plans import conversation, ledger, monitors, quality, speech, streams, text

CATALOGS = (ledger.catalog, quality.catalog, monitors.catalog, conversation.catalog, text.catalog, speech.catalog, streams.catalog)
