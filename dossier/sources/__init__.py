"""Readers of semi-structured inputs."""
