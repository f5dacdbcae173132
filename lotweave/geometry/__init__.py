"""Plane geometry on numpy coordinates, without a geometry library."""
