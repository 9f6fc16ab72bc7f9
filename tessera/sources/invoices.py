"""Invoices as XML: one note of a known format a file, or a reason why not."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.delimited import Budget
from tessera.sources.xmls import elements

#: Namespaces, versions and states of the two families of formats, and what stands for a replaced note.
CITY, NATION = "http://www.abrasf.org.br/nfse.xsd", "http://www.sped.fazenda.gov.br/nfse"
CITY_VERSIONS, NATION_VERSIONS, NATION_STATES = ("2.03", "2.04"), ("1.00", "1.01"), ("100", "102", "103", "107")
REPLACED, REPLACED_ALONE = "(?i)cancelamento|substituicao", "subst"
#: The grammars of number, instant and amount.
NUMBER = r"^[0-9]{1,15}\z"
STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?(?:Z|[+-](?:0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?\z"
AMOUNT = r"^[0-9]{1,15}(?:\.[0-9]{1,2})?\z"
BUDGET = Budget(source_bytes=2 * 2**20, expanded_bytes=2 * 2**20, xml_nodes=10_000, xml_depth=32)
#: Blanks around a value.
BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


@dataclass(frozen=True)
class Form:
    """One family: where its values are, the elements that must be there once, and what values of others must be."""

    title: str
    namespace: str
    top: str
    versions: tuple[str, ...]
    once: tuple[str, ...]
    leaves: dict[str, str]
    states: dict[str, tuple[str, ...]]  # path of a leaf -> its values
    attributes: dict[str, tuple[str, ...]]  # path -> values of its ``versao``

    @property
    def paths(self) -> list[str]:
        """The elements to hold exactly once, each way down from the top included."""
        ends = [*self.leaves.values(), *self.states, *self.attributes]
        return sorted({"/".join(p.split("/")[: i + 1]) for p in ends for i in range(p.count("/") + 1)})


#: The ways down to the values.
FORMS = (
    Form("ABRASF", CITY, "Nfse", CITY_VERSIONS, ("Nfse", "InfNfse"), {
        "number": "Nfse/InfNfse/Numero",
        "stamp": "Nfse/InfNfse/DataEmissao",
        "amount": "Nfse/InfNfse/DeclaracaoPrestacaoServico/InfDeclaracaoPrestacaoServico/Servico/Valores/ValorServicos",
    }, {}, {}),
    Form("NFS-e nacional", NATION, "NFSe", NATION_VERSIONS, ("NFSe",), {
        "number": "NFSe/infNFSe/nNFSe",
        "stamp": "NFSe/infNFSe/dhProc",
        "amount": "NFSe/infNFSe/DPS/infDPS/valores/vServPrest/vServ",
    }, {"NFSe/infNFSe/cStat": NATION_STATES}, {"NFSe/infNFSe/DPS": NATION_VERSIONS}),
)


def _early(content: Column) -> Column:
    """The issue of a file that isn't read as XML at all."""
    text = content.cast("string")
    declared = F.lower(F.regexp_extract(text, r"(?i)<\?xml[^?]*encoding\s*=\s*['\"]([^'\"]*)['\"]", 1))
    return (
        F.when(content.isNull() | ~F.octet_length(content).between(1, BUDGET.source_bytes), "TOO_LARGE")
        .when(~F.is_valid_utf8(text), "INVALID")
        .when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]") | ~declared.isin("", "utf-8"), "INVALID")
    )


def _found(form: Form) -> Column:
    """The form in the elements of a file, an aggregate: whether all is there as it must be, and the values at the ends."""
    at = lambda p: (F.col("_way") == p) & (F.col("_space") == form.namespace)
    value = F.when(F.col("children") == 0, F.regexp_replace("whole", BLANKS, ""))
    version = F.col("_version")
    single = [F.count_if(at(p)) == 1 for p in form.paths]
    single += [F.count_if((F.col("name") == n) & (F.col("namespace") == form.namespace)) == 1 for n in form.once]
    states = [F.max(F.when(at(p), value)).isin(*v) for p, v in form.states.items()]
    versions = [F.max(F.when(at(p), version)).isin(*v) for p, v in ({form.top: form.versions} | form.attributes).items()]
    whole = F.coalesce(reduce(and_, [*single, *states, *versions]), F.lit(False))
    ends = [F.max(F.when(at(p), value)).alias(n) for n, p in form.leaves.items()]
    return F.struct(whole.alias("whole"), F.concat_ws(" ", F.lit(form.title), F.max(F.when(at(form.top), version))).alias("format"), *ends).alias(form.title)


def read_notes(files: DataFrame) -> DataFrame:
    """(path, number, issued, amount, format, issue), one row for each of ``files`` (path, content): the note's fields, or the issue.

    Files become elements, and the elements of a file are aggregated where they arise, so that one row a task and file is
    shuffled. Null or empty content is ``TOO_LARGE``, as is a file beyond the budget; files of one path stay apart.
    """
    given = files.select(F.monotonically_increasing_id().alias("_file"), "path", F.when(_early(F.col("content")).isNull(), F.col("content")).alias("content"), _early(F.col("content")).alias("issue"))
    replaced = F.bool_or(F.col("name").rlike(REPLACED) | (F.col("name") == REPLACED_ALONE)).alias("_replaced")
    # The outer element of one family is optional. The way, and the only namespace on it, are found once an element.
    way = F.regexp_replace(F.array_join("steps", "/"), "^CompNfse/", "").alias("_way")
    space = F.when(F.size("spaces") == 1, F.col("spaces")[0]).alias("_space")
    found = elements(given, BUDGET, "INVALID").select("_file", "path", "name", "namespace", "children", "whole", "issue", way, space, F.col("attributes")["versao"].alias("_version"))
    notes = found.groupBy("_file", "path").agg(F.max("issue").alias("_issue"), replaced, *map(_found, FORMS))
    held = F.coalesce(*(F.when(F.col(f"`{f.title}`")["whole"], F.col(f"`{f.title}`")) for f in FORMS))
    # XML that broke off, or went beyond its budget, is no note whatever its first elements were.
    first = F.coalesce("_issue", F.when(F.col("_replaced"), "CANCELLED_OR_REPLACED"))
    read = notes.select("path", first.alias("_first"), held.alias("_n"))
    day = F.substring(F.col("_n.stamp"), 1, 10).try_cast("date")
    right = F.col("_n.number").rlike(NUMBER) & F.col("_n.stamp").rlike(STAMP) & F.col("_n.amount").rlike(AMOUNT) & F.year(day).between(1900, 2100)
    issue = F.when(F.col("_first").isNotNull(), F.col("_first")).when(~F.coalesce(right, F.lit(False)), "INVALID")
    judged = read.select("path", issue.alias("issue"), F.when(issue.isNull(), F.col("_n")).alias("_n"))
    return judged.select("path", F.col("_n.number").alias("number"), F.substring("_n.stamp", 1, 10).alias("issued"), F.col("_n.amount").cast("decimal(17,2)").cast("string").alias("amount"), F.col("_n.format").alias("format"), "issue")
