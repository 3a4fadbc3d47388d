"""One object for the whole way: take records in, resolve, build the graph, ask; and what people decide."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import scratch
from kinweave.operators import edges, events, extract, graph, ingest, members, memory, radar, resolve
from kinweave.scratch import settle
from kinweave.settings import Settings, visible_layers
from kinweave.sources import crm, files, mail
from kinweave.store import BUCKETS, Store, bucket

READERS = {".jsonl": files.jsonl, ".csv": files.contacts, ".mbox": mail.mbox, ".ics": mail.ics, ".json": crm.granola}
LOGS = {"answers": resolve.ANSWERS, "merges": resolve.MERGES, "overrides": resolve.OVERRIDES, "members": members.MEMBERS, "audit": members.AUDIT}
MADE = {"extractions": extract.EXTRACTIONS, "deals": extract.DEALS}
SETTINGS = "settings string"


class Engine:
    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.store = spark, Store(spark, root)
        if not spark.conf.get("spark.checkpoint.dir", None):
            spark.sparkContext.setCheckpointDir(f"{self.store.root}/_checkpoints")
        self.settings = settings or self.saved_settings()

    # tables

    def table(self, name: str) -> DataFrame:
        return self.store.read(name, LOGS.get(name) or MADE.get(name) or None)

    documents = property(lambda self: self.store.read("documents"))
    mentions = property(lambda self: self.store.read("mentions"))
    entities = property(lambda self: self.table("entities"))
    evidence = property(lambda self: self.table("evidence"))
    edges = property(lambda self: self.table("edges"))

    @property
    def people(self) -> DataFrame:
        return self.mentions.where("kind = 'person'")

    # writing

    def load(self, path: str) -> DataFrame:
        """Records of a file, read by its ending; a line of JSON lines that isn't JSON is named, before anything is taken in."""
        if path.lower().endswith(".jsonl") and (bad := files.bad_line(self.spark, path)):
            raise ValueError(bad)
        for ending, read in READERS.items():
            if path.lower().endswith(ending):
                return read(self.spark, path)
        raise ValueError(f"no reader for {path}")

    def sync(self, records: DataFrame, now: str, actor: str = "local", bodies: bool = True) -> dict[str, int]:
        """Take records in and bring up to date all that depends on them, in one snapshot. Gives how many documents and mentions there are.

        After the first time only what the records change is made anew (see ``_bring_up_to_date``); the result is that of ``rebuild``.
        """
        with scratch.run(self.spark):
            if not self.store.has("identities"):
                documents, mentions = ingest.ingest(self.documents, self.mentions, records, bodies)
                self.rebuild(now, actor, "sync", documents=documents.transform(settle), mentions=mentions.transform(settle))
            else:
                self._bring_up_to_date(records, now, actor, bodies)
        return {"documents": self.documents.count(), "mentions": self.mentions.count()}

    def rebuild(self, now: str, actor: str = "local", action: str = "rebuild", detail: dict | None = None, **tables: DataFrame) -> None:
        """Resolve all mentions, with what people decided, and make entities, evidence, senders and edges of them; one snapshot, ``tables`` given included."""
        with scratch.run(self.spark):
            self._rebuild(now, actor, action, detail or {}, tables)

    def _rebuild(self, now: str, actor: str, action: str, detail: dict, tables: dict[str, DataFrame]) -> None:
        table = lambda name: tables[name] if name in tables else self.table(name)
        documents, open_ = table("documents"), table("mentions")
        found = resolve.identities(documents, open_).transform(settle)
        reached = resolve.reaches(found, found, self.settings).transform(settle)
        decided = resolve.decide(found, table("answers"), self.settings, reached=reached)
        at, merged = resolve.replay(decided, resolve.values_of(found, decided), table("merges"))
        at = at.transform(settle)
        mentions = resolve.assign(open_, at).transform(settle)
        over = self._overrides(table("overrides"), found, at)
        people = mentions.where("kind = 'person'")
        self.store.commit(tables | {
            "mentions": mentions, "identities": self._identities(found, decided, at), "reached": reached, "decisions": self._decisions(found, decided, merged), "merged": merged,
            "entities": resolve.entities(documents, mentions), "evidence": resolve.evidence(documents, mentions), "senders": resolve.automated(documents, mentions, over),
            "edges": edges.rebuild_edges(documents, people, now, self.settings, signals=True), "made_for": self._made_for(now), "audit": self._logged(action, detail, actor, now),
        })

    def _bring_up_to_date(self, records: DataFrame, now: str, actor: str, bodies: bool) -> None:
        """A sync that reads again only what may have changed.

        Buckets of the records' documents are rewritten. Identities in those documents, before or after, are placed anew;
        those that are new, gone or in another place, and whoever meets them or an entity they were in, are decided again.
        Mentions that are somebody else now are rewritten with their buckets; entities that won or lost a mention are made
        anew, and so are the edges of those. All other edges only age.
        """
        s, read = self.settings, self.store.read
        d, _ = ingest.normalise(records)
        ids = d.select(F.col("id").alias("document_id")).transform(settle)
        numbers = lambda rows: sorted(r[0] for r in rows.select(bucket(F.col("document_id"))).distinct().collect())  # noqa: E731  no more than there are buckets
        touched = numbers(ids)
        rest = lambda some: [b for b in range(BUCKETS) if b not in some]
        before = read("mentions", buckets=touched)
        documents, fresh = (df.transform(settle) for df in ingest.ingest(read("documents", buckets=touched), before, records, bodies))
        all_documents = read("documents", buckets=rest(touched)).unionByName(documents)
        # who is in the documents that came in, before and now
        rows = before.join(ids, "document_id", "left_semi").unionByName(fresh.join(ids, "document_id", "left_semi"))
        here = rows.select(resolve.mention_identity().alias("id")).where("id is not null").distinct().transform(settle)
        stored, reached = self.table("identities"), self.table("reached")
        old, old_at = stored.drop("entity_id", "candidate_id", "score", "decision", "final_id"), stored.select("id", F.col("final_id").alias("entity_id"))
        everywhere = read("mentions", buckets=rest(touched)).unionByName(fresh)
        placed = resolve.identities(all_documents, everywhere.withColumn("__kw_id", resolve.mention_identity()).join(here.withColumnRenamed("id", "__kw_id"), "__kw_id", "left_semi")).transform(settle)
        same = placed.join(old.select("id", F.col("place").alias("was")), "id").where("place = was").select("id")
        changed = here.join(same, "id", "left_anti").transform(settle)
        found = old.join(here, "id", "left_anti").unionByName(placed).transform(settle)
        decided, reached = resolve.redecide(old, stored, reached, found, changed, self.table("answers"), s)
        at, merged = resolve.replay(decided, resolve.values_of(found, decided), self.table("merges"))
        at = at.transform(settle)
        moved = at.join(old_at.withColumnRenamed("entity_id", "was"), "id", "full").where(~F.col("entity_id").eqNullSafe(F.col("was"))).transform(settle)
        # mentions: the buckets that came in, and those where somebody is another now
        known = everywhere.withColumn("__kw_id", resolve.mention_identity()).join(moved.select(F.col("id").alias("__kw_id")), "__kw_id", "left_semi").select("document_id", "id").transform(settle)
        again = sorted({*touched, *numbers(known)})
        others = [b for b in again if b not in touched]
        pointed = resolve.assign((read("mentions", buckets=others).unionByName(fresh)) if others else fresh, at).transform(settle)
        mentions = read("mentions", buckets=rest(again)).unionByName(pointed)
        # entities: those that mentions left or came to
        ends = moved.select("entity_id").unionByName(moved.select(F.col("was").alias("entity_id"))).unionByName(before.join(ids, "document_id", "left_semi").select("entity_id"))
        dirty = ends.unionByName(pointed.join(ids, "document_id", "left_semi").select("entity_id")).where("entity_id is not null").distinct().transform(settle)
        over = self._overrides(self.table("overrides"), found, at).transform(settle)
        was_over = self._overrides(self.table("overrides"), old, old_at)
        told = over.exceptAll(was_over).unionByName(was_over.exceptAll(over)).select("entity_id").unionByName(dirty).distinct().transform(settle)
        renew = lambda name, made, which: self.table(name).join(which, "entity_id", "left_anti").unionByName(made)
        theirs, senders = mentions.join(dirty, "entity_id", "left_semi"), mentions.join(told, "entity_id", "left_semi")
        self.store.commit({
            "documents": documents, "mentions": pointed, "identities": self._identities(found, decided, at), "reached": reached, "decisions": self._decisions(found, decided, merged), "merged": merged,
            "entities": renew("entities", resolve.entities(all_documents, theirs), dirty), "evidence": renew("evidence", resolve.evidence(all_documents, theirs), dirty),
            "senders": renew("senders", resolve.automated(all_documents, senders, over), told), "edges": self._aged_edges(all_documents, mentions, dirty, known, moved, now),
            "made_for": self._made_for(now), "audit": self._logged("sync", {}, actor, now),
        }, {"documents": touched, "mentions": again})

    def _aged_edges(self, documents: DataFrame, mentions: DataFrame, dirty: DataFrame, known: DataFrame, moved: DataFrame, now: str) -> DataFrame:
        """The edges at ``now``: those of dirty entities made anew, the others aged."""
        people, then = mentions.where("kind = 'person'"), self.store.read("made_for", "made_for string").collect()[0][0]
        if then > now:
            return edges.rebuild_edges(documents, people, now, self.settings, signals=True)
        # who shares a document that came within the participant cap or left it, as some in it are others now
        cap = self.settings.max_participants
        docs = known.select("document_id").distinct()
        was = self.mentions.where("kind = 'person' and entity_id is not null").join(docs, "document_id", "left_semi").groupBy("document_id").agg(F.count_distinct("entity_id").alias("was"))
        is_ = people.where("entity_id is not null").join(docs, "document_id", "left_semi").groupBy("document_id").agg(F.count_distinct("entity_id").alias("n"))
        crossed = was.join(is_, "document_id", "full").where((F.coalesce("was", F.lit(0)) > cap) != (F.coalesce("n", F.lit(0)) > cap)).select("document_id")
        due = edges.ahead(self.edges, then)
        more = people.join(crossed, "document_id", "left_semi").select("entity_id").unionByName(due.select(F.col("a").alias("entity_id"))).unionByName(due.select(F.col("b").alias("entity_id")))
        all_dirty = dirty.unionByName(more.where("entity_id is not null")).distinct().transform(settle)
        return edges.rebuild_edges_for(edges.edges_at(self.edges, then, now, self.settings), documents, people, all_dirty, now, self.settings)

    def _overrides(self, log: DataFrame, found: DataFrame, at: DataFrame) -> DataFrame:
        """(entity_id, automated) as people said last."""
        said = log.withColumn("row", F.monotonically_increasing_id()).transform(settle)
        return resolve.find(said, "known", resolve.values_of(found, at)).join(said, "row").groupBy("entity_id").agg(F.max_by("automated", "said_at").alias("automated"))

    def _identities(self, found: DataFrame, decided: DataFrame, at: DataFrame) -> DataFrame:
        return found.join(decided, "id").join(at.withColumnRenamed("entity_id", "final_id"), "id")

    def _decisions(self, found: DataFrame, decided: DataFrame, merged: DataFrame) -> DataFrame:
        """Open questions and answers to them, about the entities that are left after merges."""
        rows = resolve.questions(found, decided)
        moved = resolve.survivors(merged.select(F.col("loser_id").alias("loser"), F.col("keeper_id").alias("survivor"))).withColumnRenamed("loser", "candidate_id")
        return rows.join(moved, "candidate_id", "left").withColumn("candidate_id", F.coalesce("survivor", "candidate_id")).select(*rows.columns)

    def _made_for(self, now: str) -> DataFrame:
        return self.spark.createDataFrame([(now,)], "made_for string")

    def _logged(self, action: str, detail: dict, actor: str, now: str) -> DataFrame:
        return self.table("audit").unionByName(members.entry(self.spark, action, json.dumps(detail, sort_keys=True), actor, now))

    def _log(self, name: str, rows: DataFrame, now: str, actor: str, action: str, detail: dict) -> None:
        """Add to a log of decisions and make everything anew with them, in one snapshot."""
        self.rebuild(now, actor, action, detail, **{name: self.table(name).unionByName(rows).transform(settle)})

    def extract(self, generate: Callable[[str], list[dict]], now: str, model: str, version: str = "1", effort: str = "low", limit: int | None = None, stop: Callable[[], bool] | None = None) -> dict:
        """Mine the bodies that wait; take what is grounded in as mentions and deals, and rebuild.

        Returns how many were extracted, failed and left waiting, and the error that was met last if a run of failures
        or ``stop`` ended it early.
        """
        done = extract.sweep(self.table("extractions"), self.documents)
        digest = extract.extraction_hash(F.col("body_sha256"), version, model, effort, str(extract.LEAST_CONFIDENCE))
        tried = extract.pending(self.documents, done, digest, limit).transform(settle)
        proposals = extract.propose(tried, generate, stop=stop).transform(settle)
        tried = extract.asked(tried, proposals)
        structured = self.mentions.where("origin = 'structured'")
        grounded = extract.ground(tried, extract.surest(proposals), structured).transform(settle)
        fresh = extract.record(done, tried, proposals, grounded, model).transform(settle)
        failed = fresh.where("status = 'failed'").select("document_id")
        renewed = tried.select(F.col("id").alias("document_id"))
        # a failure on the same input keeps what was found before
        same = done.join(fresh.select("document_id", F.col("input_sha256").alias("now")), "document_id").where("input_sha256 = now").select("document_id")
        renewed = renewed.join(failed.join(same, "document_id", "left_semi"), "document_id", "left_anti")
        old = self.mentions.where("origin = 'extracted'")
        found = extract.replace(extract.sweep(old, self.documents), extract.extracted_mentions(grounded), renewed)
        told = extract.replace(extract.sweep(self.table("deals"), self.documents), extract.deals(grounded), renewed)
        mentions = structured.unionByName(found.select(*structured.columns)).transform(settle)
        self.rebuild(now, "local", "extract", {"model": model}, mentions=mentions, deals=told.transform(settle), extractions=fresh)
        kinds = proposals.where("kind in ('failed', 'unasked')").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("summary").alias("error"))
        ends = {r.kind: r for r in kinds.collect()}
        n = {k: ends[k].n if k in ends else 0 for k in ("failed", "unasked")}
        told = ends["failed"].error if n["unasked"] and n["failed"] else None
        return {"extracted": tried.count() - n["failed"], "failed": n["failed"], "waiting": n["unasked"], "stopped_after": told}

    # what people decide

    def review_queue(self, viewer: str | None = None) -> DataFrame:
        return resolve.reviews(self.table("decisions"), self.mentions, self.documents, self.entities, visible_layers(viewer))

    def review_resolve(self, review_id: str, decision: str, now: str, viewer: str | None = None, actor: str = "local") -> None:
        question = self.review_queue(viewer).where(F.col("review_id") == review_id)
        if question.isEmpty():
            raise ValueError(f"no open review {review_id}")
        rows = resolve.answer(question, resolve.known_values(self.mentions), decision, now).transform(settle)
        self._log("answers", rows, now, actor, f"review_{decision}", {"review": review_id})

    def _known(self, entity: str) -> list[str]:
        found = resolve.known_values(self.mentions.where(F.col("entity_id") == entity)).groupBy("entity_id").agg(F.sort_array(F.collect_set("value")).alias("v")).collect()
        if not found:
            raise ValueError(f"no live entity {entity}")
        return found[0].v

    def merge(self, keep: str, lose: str, now: str, actor: str = "local") -> None:
        """Make two entities one; the log says by what both are known, so a rebuild merges them again."""
        kinds = {r.entity_id: r.kind for r in self.entities.where(F.col("entity_id").isin(keep, lose)).collect()}
        if keep == lose or len(set(kinds.values())) != 1 or len(kinds) != 2:
            raise ValueError("two different live entities of one kind can be merged")
        k, v = self._known(keep), self._known(lose)
        rows = self.spark.createDataFrame([(f"{keep}>{lose}", [x for x in k if x not in v] or k, v, None)], resolve.MERGES).withColumn("said_at", F.lit(now).cast("timestamp"))
        self._log("merges", rows, now, actor, "entity_merge", {"kept": keep, "merged": lose})

    def unmerge(self, lose: str, now: str, actor: str = "local") -> None:
        """Take a merge back: without its row in the log both are just what they were."""
        log = self.table("merges")
        if log.where(F.col("merge_id").endswith(f">{lose}")).isEmpty():
            raise ValueError(f"{lose} is not merged into anything")
        self.rebuild(now, actor, "entity_unmerge", {"restored": lose}, merges=log.where(~F.col("merge_id").endswith(f">{lose}")).transform(settle))

    def set_automated(self, entity: str, automated: bool, now: str, actor: str = "local") -> None:
        rows = self.spark.createDataFrame([(self._known(entity), automated, None)], resolve.OVERRIDES).withColumn("said_at", F.lit(now).cast("timestamp"))
        self._log("overrides", rows, now, actor, "automated_override", {"entity": entity, "automated": automated})

    def audit(self, limit: int = 50) -> DataFrame:
        return members.newest(self.table("audit"), limit)

    # members and settings

    def members(self) -> DataFrame:
        return members.with_counts(self.table("members"), self.documents)

    def add_member(self, name: str, email: str | None = None) -> str:
        rows = members.add(self.table("members"), name, email).transform(settle)
        self.store.commit({"members": rows})
        return members.find(rows, name).collect()[0].id

    def member(self, ref: str) -> str:
        """The id of the one member that a name, an address or an id means."""
        found = members.find(self.table("members"), ref).limit(2).collect()
        if len(found) != 1:
            raise ValueError(f"{'several members match' if found else 'no member matches'} {ref}")
        return found[0].id

    def remove_member(self, member: str, now: str, share: bool = False) -> None:
        """Drop a member and their layer, or share what it holds with all."""
        d, m = members.drop_layer(self.documents, self.mentions, member, share)
        left = self.table("members").where(F.col("id") != member).transform(settle)
        self.rebuild(now, "local", "member_removed", {"member": member, "shared": share}, documents=d.transform(settle), mentions=m.transform(settle), members=left)

    def saved_settings(self) -> Settings:
        if not self.store.has("settings"):
            return Settings()
        return Settings().changed(**json.loads(self.store.read("settings", SETTINGS).collect()[0][0]))

    def put_settings(self, now: str, **patch) -> Settings:
        """Change settings, keep them, and make the edges anew."""
        self.settings = self.settings.changed(**patch)
        row = self.spark.createDataFrame([(json.dumps(self.settings.as_dict()),)], SETTINGS)
        self.store.commit({"settings": row, "edges": edges.rebuild_edges(self.documents, self.people, now, self.settings, signals=True), "made_for": self._made_for(now)})
        return self.settings

    # reading

    def visible_entities(self, viewer: str | None) -> DataFrame:
        """Entities with a mention in a document the viewer may read, and what the viewer's own documents add to them."""
        seen = memory.visible(self.entities, self.documents, self.mentions, visible_layers(viewer), self.settings.hide_private_entities)
        return resolve.overlay(seen, self.evidence, viewer)

    def _seen(self, viewer: str | None) -> DataFrame:
        return memory.visible(self.entities, self.documents, self.mentions, visible_layers(viewer), self.settings.hide_private_entities)

    def search(self, text: str, viewer: str | None = None, limit: int = 25) -> DataFrame:
        return memory.search(self._seen(viewer), self.evidence, text, viewer, limit)

    def resolve_ref(self, ref: str, viewer: str | None = None) -> str:
        """The id of the one entity that an id, a name or an address means; else an error with the candidates."""
        seen = self._seen(viewer)
        rows = memory.resolve_ref(memory.search(seen, self.evidence, ref, viewer, 5), seen.where(F.col("entity_id") == ref)).collect()
        if not rows:
            raise LookupError(f"no entity matches {ref}")
        if not rows[0].sure:
            raise LookupError(f"{ref} is ambiguous: " + ", ".join(sorted(f"{r['name']} ({r.entity_id})" for r in rows)))
        return rows[0].entity_id

    def _named(self, rows: DataFrame, column: str) -> DataFrame:
        return rows.join(self.entities.select(F.col("entity_id").alias(column), "name"), column, "left")

    def strongest_connections(self, who: str, viewer: str | None = None, limit: int = 25) -> DataFrame:
        return self._named(graph.strongest_connections(self.edges, who, viewer, limit, self.settings), "other").orderBy(F.desc("weight"), "other")

    def warm_path(self, a: str, b: str, viewer: str | None = None, max_hops: int = 4) -> DataFrame:
        return graph.best_path(graph.warm_paths(graph.visible_graph(self.edges, viewer, self.settings), a, b, max_hops, self.settings))

    def private_path(self, a: str, b: str, viewer: str | None = None, max_hops: int = 4) -> DataFrame:
        """Steps of a shorter path through others' layers; who the viewer can't see stays nameless."""
        return graph.redact(graph.private_path(self.edges, a, b, viewer, max_hops, self.settings), self.entities, self._seen(viewer))

    def introducers(self, a: str, b: str, viewer: str | None = None) -> DataFrame:
        return graph.introducers_of(self.edges, a, b, viewer, s=self.settings)

    def private_introducers(self, a: str, b: str, viewer: str | None = None) -> DataFrame:
        return graph.private_introducers(self.edges, a, b, viewer, self.settings)

    def graph_view(self, viewer: str | None = None, limit: int = 300, focus: str | None = None, radius: int = 2) -> tuple[DataFrame, DataFrame]:
        people = self._seen(viewer).where("kind = 'person'")
        if focus is not None and people.where(F.col("entity_id") == focus).isEmpty():
            raise LookupError(f"no entity {focus}")
        return graph.graph_view(graph.drawn_links(self.edges, people, viewer, self.settings), people, limit, focus, radius)

    def graph_totals(self, viewer: str | None = None, limit: int = 300, focus: str | None = None, radius: int = 2) -> DataFrame:
        """What ``graph_view`` with the same arguments was cut from."""
        people = self._seen(viewer).where("kind = 'person'")
        links = graph.drawn_links(self.edges, people, viewer, self.settings)
        return graph.view_totals(links, people, self.graph_view(viewer, limit, focus, radius)[0])

    def _robots(self) -> DataFrame:
        return self.table("senders").where("automated").select("entity_id")

    def radar(self, now: str, viewer: str | None = None, limit: int = 25, who: str | None = None, include_automated: bool = False) -> DataFrame:
        """The relationships that are most due, of all or of one person; automated senders have none."""
        contacts = radar.pair_contacts(self.documents, self.people, visible_layers(viewer), self.settings, None if include_automated else self._robots())
        rows = radar.contact_radar(contacts, now, self.settings, distinct=True)
        return radar.most_urgent(rows if who is None else radar.of_person(rows, who), limit)

    def radar_summary(self, now: str, viewer: str | None = None) -> DataFrame:
        return radar.summary(radar.contact_radar(radar.pair_contacts(self.documents, self.people, visible_layers(viewer), self.settings, self._robots()), now, self.settings, distinct=True))

    def touches(self, viewer: str | None = None) -> DataFrame:
        return events.touches(self.documents, self.mentions, visible_layers(viewer))

    def list_events(self, viewer: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
        return events.list_events(self.touches(viewer), since, until).orderBy("event_date", "event_name")

    def resolve_event(self, ref: str, viewer: str | None = None) -> DataFrame:
        return events.resolve_event(self.list_events(viewer), ref)

    def event_history(self, who: str, viewer: str | None = None, limit: int = 100) -> DataFrame:
        return events.event_history(self.touches(viewer), who, limit)

    def event_guests(self, event: str, viewer: str | None = None, tier: str | None = None) -> DataFrame:
        return self._named(events.event_guests(self.touches(viewer), event, tier), "entity").orderBy("rank", "name", "entity")

    def guest_league(self, sort: str, viewer: str | None = None, include_hosts: bool = False, **how) -> DataFrame:
        out = self._robots().select(F.col("entity_id").alias("entity"))
        if not include_hosts:
            out = out.unionByName(self.entities.join(events.hosts(self.documents), "name", "left_semi").select(F.col("entity_id").alias("entity")))
        return self._named(events.guest_league(self.touches(viewer), sort, leave_out=out, **how), "entity")

    def entity_brief(self, who: str, viewer: str | None = None) -> dict[str, DataFrame]:
        """entity, connections, documents, withheld (a number), deals of an organisation or events of a person; tables of few rows."""
        layers = visible_layers(viewer)
        entity = self.visible_entities(viewer).where(F.col("entity_id") == who)
        row = entity.collect()
        if not row:
            raise LookupError(f"no entity {who}")
        brief = {
            "entity": entity, "connections": self.strongest_connections(who, viewer, 10), "documents": memory.documents_of(self.documents, self.mentions, who, layers),
            "withheld": memory.withheld(self.documents, self.mentions.where(F.col("entity_id") == who), layers),
        }
        if row[0].kind == "org":
            return brief | {"deals": memory.deals_of(self.table("deals"), self.documents, row[0].aliases, layers)}
        touches = self.touches(viewer).where(F.col("entity") == who)
        return brief | {"events": events.guest_summary(touches), "recent_events": events.event_history(touches, who, 12)}

    def brief_markdown(self, who: str, viewer: str | None = None) -> str:
        """The brief as a Markdown page."""
        return memory.markdown(self.entity_brief(who, viewer)).collect()[0].text

    def meeting_prep(self, who: str, viewer: str | None = None, me: str | None = None) -> dict[str, DataFrame]:
        """The brief, and with ``me`` the ways to get there."""
        prep = self.entity_brief(who, viewer)
        if me is None:
            return prep
        return prep | {
            "warm_path": self.warm_path(me, who, viewer), "private_path": self.private_path(me, who, viewer), "introducers": self._named(self.introducers(me, who, viewer), "mutual"),
            "private_introducers": self.private_introducers(me, who, viewer),
        }

    def company_memory(self, ref: str, viewer: str | None = None) -> dict[str, DataFrame]:
        """Deals under any name of a company, its documents and people; deals also of a company that isn't resolved."""
        layers = visible_layers(viewer)
        known = self.visible_entities(viewer)
        best = memory.company_names(memory.search(self._seen(viewer), self.evidence, ref, viewer, 5), ref).collect()
        names = best[0].names if best else [r[0] for r in self.spark.range(1).select(memory.norm_org(F.lit(ref))).collect() if r[0]]
        found = {"deals": memory.deals_of(self.table("deals"), self.documents, names, layers)}
        if not best:
            return found
        who = best[0].entity_id
        return found | {"entity": known.where(F.col("entity_id") == who), "documents": memory.documents_of(self.documents, self.mentions, who, layers, 15), "people": memory.people_of(known, names)}

    def stats(self, viewer: str | None = None) -> DataFrame:
        return memory.counts(
            self.documents, self.mentions, self.entities, self.table("decisions"), self.edges, self.table("extractions"), visible_layers(viewer), self.settings.hide_private_entities
        )

    def documents_overview(self, viewer: str | None = None) -> dict[str, DataFrame]:
        layers = visible_layers(viewer)
        return {"sources": memory.source_breakdown(self.documents, layers), "recent": memory.recent_documents(self.documents, layers), "counts": memory.layer_counts(self.documents, layers)}
