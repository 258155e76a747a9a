"""Whole jobs: steps that are written, recorded and guarded before readers see their result."""
