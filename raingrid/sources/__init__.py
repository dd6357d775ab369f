"""Readers and writers for station sheets and mooring text."""
