"""Analytics queries, reports and the views that derive domain tables from other tables."""
