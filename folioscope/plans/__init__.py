"""Registered queries and their oracles."""

from folioscope.plans import attempts, documents, evidence, fences, files, forms, gates, integrity, reconcile, recovery, rewriting, routing, structure, transcripts

PLANS = (attempts, documents, structure, routing, transcripts, gates, rewriting, reconcile, recovery, evidence, forms, integrity, fences, files)
