"""Sell-in analytics and corpus preparation as Spark jobs."""
