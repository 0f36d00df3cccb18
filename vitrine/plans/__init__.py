"""Searches: predicate trees and paged queries as DataFrames."""
