"""Audits of source trees and documents, expressed as Spark DataFrame jobs."""
