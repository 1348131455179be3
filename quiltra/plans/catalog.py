"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from . import cameras, descriptors, detection, filters, formats, frames, images, layers, learning, routes, scenes, vectors, writing

QUERIES: dict = {**images.QUERIES, **vectors.QUERIES, **frames.QUERIES, **formats.QUERIES, **layers.QUERIES, **descriptors.QUERIES, **filters.QUERIES, **scenes.QUERIES, **cameras.QUERIES, **detection.QUERIES, **learning.QUERIES, **writing.QUERIES, **routes.QUERIES}
SQL: dict = {**images.SQL, **vectors.SQL, **frames.SQL, **formats.SQL, **layers.SQL, **descriptors.SQL, **filters.SQL, **scenes.SQL, **cameras.SQL, **detection.SQL, **learning.SQL, **writing.SQL, **routes.SQL}
FLAGSHIP = "abs_difference_sum"
