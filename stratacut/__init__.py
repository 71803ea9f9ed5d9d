"""Layered stencils over collections of pictures and SVG documents, as Spark jobs."""
