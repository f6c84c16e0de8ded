"""Scans of exports, text lines, receipt scans and detections."""
