"""Registered queries: each module of the catalogue holds QUERIES and SQL."""

from footfall.plans import accuracy, assessment, barriers, cleaning, composite, evidence, fields, files, graphs, logs, scoring, spatial, streams

CATALOGUE: list = [scoring, cleaning, spatial, assessment, accuracy, logs, graphs, evidence, files, streams, composite, fields, barriers]
