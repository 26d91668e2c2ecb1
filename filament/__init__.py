"""Filament: file-metadata integration, query and data-preparation operators for Spark."""
