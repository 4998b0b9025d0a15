"""Geometry that expressions cannot say: numpy on the polygons of one group."""
