"""Operators of a training-data pipeline over documents and web pages.

One module per operator, ``queries`` registers them. Nothing outside this
package imports it.
"""
