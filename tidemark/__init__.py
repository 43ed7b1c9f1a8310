"""Predictive lossless codecs and codec analytics for many series and texts, on Spark."""
