"""What a model is asked for each semantic rule: the decision it must take, what counts, what doesn't, why it matters, and passages that show the trait.

Each entry is a code followed by lines of `ask`, `counts`, `spare`, `why` and one `shows` per example; `counts` and `spare` may be missing.
"""

from __future__ import annotations

from dataclasses import dataclass

TEXT = """
JEV001
ask: Is the main job of this paragraph to say that something is coming, so that cutting it would cost the reader no information?
counts: Sentences that give the number or outline of the points ahead, repeat the assignment, or clear the throat before the answer.
spare: A first sentence that already makes a claim, and a definition that later text needs.
why: Readers wait for the answer while the text talks about itself; begin with the answer.
shows: Three things need to be looked at before this can be decided, and we go through them one by one.
shows: Before we get to the numbers, a few words on how this page is laid out.

JEV002
ask: Does the writer talk here about how they are thinking, choosing words or putting the text together, where the subject itself should stand?
counts: Remarks on being precise, careful or fair about what is about to be said; talk of what the text is doing now.
spare: A first-person account whose subject is what someone decided or believed at the time.
why: Notes of the drafting process are for the drafter; keep what they led to.
shows: Let me be careful with this part, because it is easy to overstate.
shows: I am going to separate two questions here so that I don't mix them up.

JEV003
ask: Must the reader pass several pieces of evidence or background here before being told what they are evidence for?
counts: Runs of facts, figures or circumstances that end in the claim, far longer than the claim needs.
spare: One reason given before or behind a short claim; a narrative that has to run in time.
why: Evidence is read better once one knows what it supports.
shows: Orders fell in May. Two suppliers closed. The warehouse had been half empty since spring, and the lease was up. All this is why we moved.

JEV004
ask: Does this paragraph, standing at an end, say the answer over again and turn back to the question it started from?
counts: Openings like 'so, to come back to what you asked', and closings that only repeat what was shown.
spare: A last paragraph with a consequence, a number or a next step that wasn't there before.
why: Whoever got this far has the answer; a second serving reads as filler.
shows: So, coming back to where we began: yes, the old valve can be kept.
shows: And that, in the end, is the answer to the question of the roof.

JEV005
ask: Is a small point that hardly anyone would doubt defended here as though somebody had attacked it?
counts: Several reasons for something plain, or an objection that is raised only to be turned down.
spare: The answer to a doubt that the text quotes or that its readers are known to have.
why: Defence makes a reader look for the weakness; state small points once.
shows: Using two bolts is reasonable. Some may say one would do, but two are not excessive, and nobody would call them wasteful.

JEV006
ask: Does the text say in so many words that it is now summing up or coming to its end?
counts: Set phrases for concluding or summarising, and their paraphrases.
spare: An ending that simply is one; a heading named Summary that the format asks for.
why: The blank space below tells the reader that this is the end.
shows: To sum up, the three pumps differ mostly in price.
shows: In conclusion, the ferry needs a new engine.

JEV007
ask: Is this paragraph a forecast or a repetition of the section that it belongs to, with nothing of its own?
counts: What a section is going to cover, or what it has just covered, listed again.
spare: A summary that the reader is meant to read instead of the section, such as an abstract.
why: A text that retells itself at each level is read two or three times for one content.
shows: In this section we have seen how the gate is opened, how it is closed and how it is oiled.

JEV008
ask: Are the points of a list set here as running sentences that begin with their number?
counts: Sentences or paragraphs in a row that open with first, second, third or the like.
spare: One ordinal that tells a real sequence in time or a rank.
why: A list set as a list can be skimmed; counted paragraphs hide it.
shows: The first reason is cost. The second reason is time. The third reason is the weather.

JEV009
ask: Does the ending go on adding clauses and reservations after its point has been made?
counts: Closing sentences hung together by and, but, while or though, each with a little less to say.
spare: A long last sentence that builds up to a single point.
why: The last point stays with the reader only if the text stops there.
shows: The bridge will open in May, though rain may delay it, and of course prices may change, but all in all we are hopeful, while keeping in mind that much can happen.

JEV010
ask: Could this whole piece have been made by filling in the usual stations of its kind in the usual order, whatever its subject?
counts: Letters that greet, praise, state a theme, present the sender and ask for a talk; essays of hook, three points and outlook.
spare: A conventional order that the content needs, such as method before result.
why: A reader who knows the pattern stops reading for what is said.
shows: A message that praises the recipient's recent work, finds an industry at a turning point, tells who we are, and hopes for fifteen minutes of their time.

JEV011
ask: Does this passage speak of its own revision, in a way that only someone who followed the editing could use?
counts: Badges for added or removed items, thanks for feedback, references to an earlier version or to the wish for a change.
spare: A change log, a dated stamp, an erratum, and text whose subject is how something changed.
why: The reader has only this version; what it replaced is noise.
shows: Suppliers by region (now with the two that were missing last time).
shows: Shortened as you asked.

JEV012
ask: Having read the whole piece, would a reader be at a loss to tell in one sentence what they are supposed to know or do now?
counts: Pieces without a main claim, and pieces most of whose length has nothing to do with it.
spare: Reference pages, minutes and lists that are there to be looked up; a clear point that comes late or with detours.
why: Single sentences can be sound while the page says nothing; write the point down first and keep what serves it.
shows: Five paragraphs about how reading habits are in motion that neither report a finding nor propose a step.

JEV013
ask: Does this paragraph begin with background, a scene or an aside, so that its point arrives in a later sentence?
counts: Paragraphs whose first sentence could be cut without losing the point.
spare: Paragraphs whose first sentence is already the point.
why: People's essays wander now and then; a piece in which no paragraph does was laid out by rule. It is reported if hardly any paragraph shows the trait.
shows: My grandmother kept bees behind the mill. Nobody thought much of it then. It turned out that her notes are the longest record of flowering times in the valley.

JEV014
ask: Is the first line or subtitle of this piece a table of contents in the shape of a sentence, with a teaser for its second half?
counts: A noun phrase joined by plus or and to a promise such as what the manual leaves out.
spare: A first line that states a finding, a fact or plainly what the page holds; an ordinary title.
why: It takes the place of the one sentence everybody reads and says nothing in it.
shows: The new timetable, plus the one thing the leaflet won't tell you.

JEV101
ask: Is the matter of this passage made out to be of far greater consequence than anything in it supports?
counts: Claims that an ordinary product, change or habit alters society, an epoch or how people think.
spare: Large stakes that are backed by facts in the passage or are plainly the subject.
why: Readers discount the rest of a text that begins too loudly.
shows: A better stapler is not a convenience; it changes how mankind keeps its memory.

JEV102
ask: Does the passage use a self-made abstract name for a problem or effect as if it were a known term?
counts: Compounds with paradox, trap, gap, debt, creep or tax that are neither defined nor attributed.
spare: Terms that are established in the field, quoted, or defined where they stand.
why: A label looks like an explanation and takes its place.
shows: Teams fall into the calendar trap.
shows: This is the politeness tax at work.

JEV103
ask: Does a sentence here seem made for being quoted by itself, while telling the reader nothing that can be checked or used?
counts: Maxims, antitheses and one-line paragraphs that sound final.
spare: A short sentence that states a fact or a decision.
why: It draws attention to the writer and away from the matter.
shows: Speed is a choice. Patience is a strategy.

JEV104
ask: Is a comparison or image used here that makes its object no clearer than plain words would?
counts: Images from a distant field, stacked images, and figures that need explaining.
spare: Idioms nobody notices, and an analogy on which an explanation rests.
why: An image that doesn't explain has to be decoded before one can read on.
shows: The budget is a jazz band with a missing drummer.

JEV105
ask: Does the writer confess something here that costs them nothing, in order to appear honest?
counts: Announced frankness, and admissions that are really praise of oneself.
spare: An admission with a real cost, or a limitation that the reader needs to know.
why: Announced honesty makes the remainder look less so.
shows: I will be honest, and this is hard to say: I sometimes care too much about quality.

JEV106
ask: Does the passage speak of 'we' for people who haven't been made a group, such as the writer together with all readers?
counts: Shared feelings, habits or duties ascribed to the reader.
spare: A named team, authors of a paper, or people who did something together.
why: Readers who don't share the feeling are lost at that word.
shows: We have all stared at a blank form and wondered who we have become.

JEV107
ask: Do groups of three parallel words or clauses follow one another here for the sound of it?
counts: Two or more triples in near succession; a triple whose members mean nearly the same.
spare: Three things that happen to be three.
why: The rhythm is heard before the content and sounds the same whatever the content is.
shows: It is faster, lighter and calmer. It saves time, money and nerves. It just works, just fits and just lasts.

JEV108
ask: Does a phrase here announce a surprise or disclosure that ordinary information then follows?
counts: Questions and colons that only delay, and promises of the part nobody talks about.
spare: A turn that is really unexpected and needs its set-up.
why: Suspense without a surprise teaches the reader to skip.
shows: And now comes the part nobody expected: the shop is closed on Sundays.

JEV109
ask: Is the reader led by the hand here like a pupil, by someone who knows better?
counts: Invitations to break things down together, praise for following, questions with an answer at once.
spare: Lessons for learners who came for one; steps of an instruction.
why: Adult readers want the matter, not the lesson.
shows: Let's take this slowly, step by step. Ready? Good. What is a valve, then?

JEV110
ask: Is the reader asked here to picture a better future in which the thing on offer is a matter of course?
counts: Invitations to imagine, and scenes of a coming everyday without any evidence.
spare: A stated forecast with its grounds; fiction.
why: A scene is not an argument, and it can't be checked.
shows: Picture a town in which no letter is ever late again.

JEV111
ask: Does the text end in a stock phrase that asks for nothing and commits to nothing?
counts: Offers to answer any questions, wishes that something was helpful, cheerful goodbyes out of a template.
spare: A real request, an appointment, or contact details that are needed.
why: The last line is the most read one; leave it to the request or to the matter.
shows: I hope this was useful, and don't hesitate to reach out at any time!

JEV112
ask: Does this document greet the reader or take leave of them although it is no letter or message?
counts: Hello, dear reader, a signature or regards in an article, a report or a manual.
spare: Letters, mails and quoted ones.
why: It shows that the text was written as an answer to somebody else.
shows: Hi there! Here is the maintenance plan you asked for. Best wishes!

JEV113
ask: Does a sentence here set one thing against another and end in a bare auxiliary such as did, was or couldn't?
counts: Short two-part reversals whose second half leaves its verb out for effect.
spare: Ordinary ellipsis in an answer or a comparison.
why: The effect wears off at the second use, and the missing verb is often the information.
shows: The contract survived; the company didn't.

JEV114
ask: Is a factual statement followed here, in the same sentence, by a general saying that only repeats it in a grander way?
counts: Semicolons, dashes or and-clauses behind which a maxim stands.
spare: A second clause that adds a cause, a limit or a consequence.
why: The fact was enough; the maxim makes the reader doubt it.
shows: The index was rebuilt at night; what you don't measure, you don't own.

JEV115
ask: Does this passage explain something to people in the manner of a standard or a contract?
counts: Shall and must without an addressee, defined-term capitals, conditions before any verb.
spare: Actual specifications, laws and terms of use.
why: One has to translate it back before one can act on it.
shows: A conforming reader shall, upon receipt of a page, ascertain its number prior to any further processing.

JEV201
ask: Is one single idea said several times here in other words?
counts: Sentences that could be exchanged for each other without loss.
spare: A claim followed by an example, a number or an exception.
why: The reader looks for the difference and finds none.
shows: The door sticks. It doesn't open easily. Opening it takes effort, as it tends to stay shut.

JEV202
ask: Is an ordinary fact given a meaning here that nothing in the passage shows?
counts: Participles at the end of a sentence that highlight, underline or reflect something large.
spare: A consequence that is stated with its cause.
why: It looks like analysis, but nothing was analysed.
shows: The library opens at eight, underlining its deep commitment to the community.

JEV203
ask: Is a difficulty named here and waved aside at once, without anything being said about it?
counts: Despite or although with challenges, then a cheerful main clause.
spare: A difficulty together with what is done about it or what it costs.
why: Whoever has that difficulty learns that the text doesn't take it seriously.
shows: Despite some challenges with the brakes, the future of the line looks bright.

JEV204
ask: Is a statement of this passage laid at the door of people who aren't named?
counts: Experts, studies, critics, observers or many people, without any that could be looked up.
spare: Attributions with a name, a title, a link or a footnote; common knowledge.
why: Nobody can check an authority without a name.
shows: Specialists agree that the method is sound.
shows: Research has shown that short meetings work better.

JEV205
ask: Does the passage claim that something is famous, classic or generally accepted, as though this proved it?
counts: As everyone knows, the well-known principle of, the canonical way.
spare: A standard that is named and can be looked up.
why: What is well known needs no assurance, and what isn't gets none.
shows: The well-known law of small kitchens applies here.

JEV206
ask: Are several well-known companies, inventions or upheavals lined up here to lend weight to a claim about something else?
counts: Three or more names in a row, none of which is compared in any detail.
spare: One case that is worked out.
why: The list suggests a pattern and spares the writer from showing one.
shows: Railways did it. The telephone did it. Container ships did it. Now garden sheds will.

JEV207
ask: Could this passage stand word for word on the page of almost any other organisation or person?
counts: Commitment to quality, passionate teams, tailored solutions, values without an instance.
spare: Statements with something that is only true here: a number, place, product or date.
why: What fits everyone tells nothing about this one.
shows: We are a dedicated team that puts people first and strives for excellence in all we do.

JEV208
ask: Are details about the addressee dropped in here that show no more than that somebody looked up their page?
counts: A school, a job title or a recent post mentioned and not used.
spare: A detail on which the request or the argument depends.
why: The reader notices that the rest is the same for all.
shows: As a fellow graduate of Lindor who posted about bees last week, you will love our ledger software.

JEV209
ask: Does an absolute denial take the place of the evidence here?
counts: Nothing else could have, no other explanation, there is no way that, without the alternatives being examined.
spare: A denial behind which the excluded cases stand.
why: To have found nothing isn't to have shown that there is nothing.
shows: Nothing but the new seal can have caused the leak.

JEV210
ask: Does the passage say of a part, which it has shown, that it is all there is?
counts: That is the whole point, the entire story, everything that matters.
spare: A total that was counted or follows from what is said.
why: The claim is larger than what was shown, and the reader sees it.
shows: Two of the gauges agree, and that is the whole story.

JEV211
ask: Does the passage tell the reader afterwards how important something was that they have already read?
counts: That is why the third paragraph mattered, this is the key insight from above.
spare: A cross-reference that is needed to go on.
why: If it mattered, it was to be noticed then.
shows: That is what made the note about the hinge so important.

JEV212
ask: Does the passage say that its source is silent or missing, and then tell what probably stood there?
counts: Likely, presumably or no doubt behind records are scarce or little is known.
spare: A guess with its grounds and its likelihood.
why: A guess of the usual kind is read as a finding.
shows: Little is known of her youth, which she probably spent among books like so many of her time.

JEV301
ask: Does this passage use words in fashion with text generators where they carry no meaning?
counts: Delve, tapestry, landscape, testament, crucial, foster, leverage, seamless, robust and their like, as padding.
spare: Such a word in its proper meaning, such as a robust estimator or a woven tapestry.
why: The words are read as a sign that nobody chose them.
shows: Delve into the rich tapestry of our vibrant garden landscape.
shows: This plays a pivotal role in fostering robust teamwork.

JEV302
ask: Does an adverb here make an ordinary event sound meaningful?
counts: Quietly, fundamentally, deeply, profoundly, remarkably, where the sentence is as true without it.
spare: Adverbs that say how something was done.
why: The adverb claims what the sentence ought to show.
shows: The new form quietly changes how members pay.

JEV303
ask: Is a grand noun used here for a thing that has a plain name?
counts: Journey, realm, ecosystem, symphony, cornerstone, beacon for a process, a field, a group, a part.
spare: The same nouns for the things that they name.
why: The reader has to find out first which thing is meant.
shows: Your journey to a clean oven begins with this sponge.

JEV304
ask: Does this passage praise its object in the way an advertisement would, where it should describe?
counts: Superlatives and adjectives of praise without a measure; calls to experience something.
spare: A judgement that is backed by a comparison or attributed to someone.
why: Praise from the seller's side is no information.
shows: Nestled by the stunning river, the mill offers an unparalleled experience for all senses.

JEV305
ask: Is there a connecting phrase here between parts that don't stand in that relation?
counts: Moreover, that said, with this in mind, it is worth noting, as mere padding.
spare: A connective whose relation can be pointed out.
why: A wrong signpost costs more than none.
shows: That being said, it is also worth noting that the key is green.

JEV306
ask: Does the passage say 'serves as', 'stands as', 'represents' or the like where 'is' is meant?
counts: Verbs of standing for something, and of boasting or featuring for having.
spare: A thing that really serves a function in another's place.
why: Is and has are shorter and claim no more than they show.
shows: The shed serves as the storage place for rakes and stands as the oldest hut of the yard.

JEV307
ask: Is the same thing called by ever new names here so as not to repeat a word?
counts: Two or more substitutes for one referent within few sentences.
spare: Pronouns, and names that add something the reader needs.
why: A new name suggests a new thing.
shows: The pump was late. The device came on Monday. Once the apparatus stood, the machine was tested.

JEV308
ask: Does a sentence here end in a short fragment behind a comma that was meant to strike?
counts: Tails like no less, and fast, every time, that add emphasis alone.
spare: A final phrase with a place, a time or a condition in it.
why: The weight falls on the fragment, not on the point.
shows: The lid closes by itself, every single time.

JEV309
ask: Does an adverb of certainty stand here where a proof should?
counts: Plainly, clearly, obviously, provably, demonstrably, outright, without a demonstration.
spare: The same words where the evidence stands next to them.
why: Evident things don't need the word, and others aren't made so by it.
shows: The second reading is plainly wrong.

JEV310
ask: Does a compound word assure here how carefully something was verified?
counts: Byte-identical, re-derived, double-checked, audit-proof, used as praise.
spare: A report of the check itself with its means and result.
why: The claim names a check and doesn't show it.
shows: All totals are independently re-derived and line-verified.

JEV311
ask: Is a program, a document or a routine spoken of here as if it were a court or an official?
counts: It refuses, rules, permits, forbids, grants, adjudicates; carve-outs and verdicts.
spare: Real courts and contracts, and terms fixed in the field, such as a refused connection.
why: The reader has to translate the image into what happens.
shows: The validator rules on each line and grants no appeal.

JEV312
ask: Is something named here by what wasn't done to it, with a word made up for the purpose?
counts: Un- and non- coinages for a state that has no such name.
spare: Common words such as unread, unpaid, unsigned.
why: It tells what is missing, but not what there is.
shows: The ungated branch stays unwired until spring.

JEV401
ask: Is the person or thing that acts left out here by a passive although the reader needs to know who it is?
counts: Decisions, faults and duties without anyone who decides, errs or must.
spare: Passives whose actor is unknown, unimportant or named.
why: Nobody can ask back if nobody acted.
shows: It was decided that the fees would be raised and the complaints be ignored.

JEV402
ask: Is what happens here put into an abstract noun, with an empty verb beside it?
counts: Perform an examination, make a decision, the implementation of, in place of examine, decide, build.
spare: Nouns that are terms, and actions that are really spoken of as things.
why: Verbs are shorter and name who acts.
shows: The committee undertook an examination of the feasibility of a reduction of costs.

JEV403
ask: Does a phrase of several words stand here for which one word would do?
counts: In order to, due to the fact that, at this point in time, has the ability to.
spare: Phrases with a shade of meaning that the one word lacks.
why: Each takes a little time and gives nothing.
shows: Due to the fact that it rained, we were in a position to stay.

JEV404
ask: Are claims weakened here by words of doubt that don't say what is doubtful or how much?
counts: Could potentially, somewhat, it seems that perhaps, stacked.
spare: Stated uncertainty: a range, a condition, a source that disagrees.
why: The reader can't tell whether the writer knows.
shows: It may perhaps be somewhat possible that the tank could leak.

JEV405
ask: Do three or more nouns stand in a row here, of which all but the last modify?
counts: Chains whose inner grouping has to be guessed.
spare: Names, titles, and terms that readers know as a unit.
why: One has to read to the end and then backwards.
shows: The ferry ticket price change approval form is missing.

JEV406
ask: Is a noun used here as a verb that isn't one in common use?
counts: Coinages of the moment such as to bucket, to footnote, to whiteboard.
spare: Verbs that dictionaries have, and terms of the trade for its own people.
why: It saves the writer a word and stops the reader.
shows: We'll drawer these letters and calendar the rest.

JEV407
ask: Is a 'that' missing here in front of a long clause, so that one first takes its subject for an object?
counts: Verbs of saying, knowing, showing with a clause of many words behind them.
spare: Short clauses, and speech.
why: A reader who went wrong has to start the sentence again.
shows: The survey found the farmers who sold their milk to the new dairy earned less.

JEV408
ask: Do a long list or an aside stand here between a subject and its verb?
counts: A dozen words or more between them.
spare: Short asides, and relative clauses that define the subject.
why: The reader has to keep the subject in mind until something happens to it.
shows: The boat, which had been bought in March, painted twice, lent to the school and returned without its oars, sank.

JEV501
ask: Does this passage tell what something isn't, where it could have told what it is?
counts: Denials of what nobody claimed, and not-this-but-that frames.
spare: Corrections of a known error, prohibitions, stated limits.
why: After a denial the reader still doesn't know.
shows: This isn't a cookbook, nor a diary. It is not about recipes.

JEV502
ask: Does this passage stay in general notions where the reader would need a number, name, place or instance?
counts: Aspects, factors, elements, approaches, solutions without any that is named.
spare: General statements that are illustrated nearby; definitions.
why: Abstract statements are hard to check and to remember.
shows: Various factors influence the outcome in different ways, depending on the context.

JEV503
ask: Does the passage rely on words such as very, quite, rather, really or pretty for its force?
counts: Intensifiers that could be cut or replaced by a stronger word.
spare: Quite or rather in their exact sense; direct speech.
why: They weaken what they should strengthen.
shows: It was a really very good and quite important meeting.

JEV504
ask: Are several main clauses strung together here by and, but, so or which without any being the main one?
counts: Sentences of two or more loosely joined clauses, one after another.
spare: One compound sentence among others; a child's or a speaker's voice.
why: All that is said is equally important, hence nothing is.
shows: We went to the yard and the gate was open, so we looked in, and there was a cart, which was broken.

JEV505
ask: Are the members of a series here of different grammatical form?
counts: Lists that mix nouns, infinitives and clauses.
spare: Series whose members really differ in kind.
why: The reader stumbles over the member that doesn't fit.
shows: The job includes cleaning, to answer the phone, and that bills are paid.

JEV601
ask: Does this passage of a manual tell what a thing is or can do, where the reader wants to know how to do something with it?
counts: Descriptions of features and parts without any action of the reader.
spare: Concept pages and reference entries that are meant as such.
why: People open manuals in the middle of a task.
shows: The filter module offers extensive options and is part of the settings area.

JEV602
ask: Is there an abbreviation or a term of the trade here that its likely readers don't know and that isn't explained?
counts: First uses without an expansion or a few words of definition.
spare: Abbreviations better known than what they stand for; terms defined earlier on the page.
why: One unknown word can make a paragraph useless.
shows: Set the QRV before you start the second BLM cycle.

JEV603
ask: Does this documentation tell how things differ from an earlier version, instead of how they are?
counts: Now, no longer, has been changed to, unlike before.
spare: Release notes and migration guides.
why: A new reader doesn't know the old state and needn't.
shows: The button no longer opens the old list but now opens the new one instead.

JEV610
ask: Must a reader of this document go through background before learning its conclusion or what is asked of them?
counts: Conclusions, recommendations or requests that first appear near the end.
spare: Documents that open with a summary that says it.
why: Those who decide read the first lines.
shows: A memo that tells two years of history and asks for the money in its last sentence.

JEV620
ask: Does an opinion or a coloured word of the writer's stand here within what is presented as a report?
counts: Verdicts, irony and loaded adjectives that nobody is quoted with.
spare: Quoted opinions, and pieces marked as comment.
why: Readers can no longer tell what happened from what is thought of it.
shows: The mayor finally admitted the disastrous plan on Tuesday.

JEV630
ask: Does this copy list properties of the product without saying what the reader gains by them?
counts: Materials, counts and technical data alone.
spare: Data sheets, and features followed by their use.
why: Buyers have to work out themselves why it matters, and most don't.
shows: With a 40 mm steel core, twin seals and four modes.

JEV640
ask: Do the speakers of this dialogue say outright what they feel or what the plot needs the audience to know?
counts: Named feelings, and facts that both speakers know already.
spare: Directness that marks a character or a break in the scene.
why: A scene that tells all leaves nothing to play.
shows: I am angry with you because you left me, your sister, alone at our father's funeral ten years ago.

JEV650
ask: Has a word or the word order been bent here to reach a rhyme?
counts: Inversions nobody would say, padding words, and rhyme words that don't fit the sense.
spare: Rhymes that fall naturally, and archaic diction held throughout.
why: The reader hears the effort and not the verse.
shows: The moon above so brightly shone, upon the hill the cow did moan, a stone it did upon.

JEV660
ask: Does this entry of a change log fail to tell what was changed, so that a user couldn't know whether it concerns them?
counts: Various fixes, improvements, stability, updates without an object.
spare: Short entries that name the part and the effect.
why: Change logs are read in order to find one's own problem.
shows: Bug fixes and performance improvements.

JEV670
ask: Does this line of a resume lack either a verb of doing or a result that could be verified?
counts: Responsible for, involved in, duties included; results without a number or a thing.
spare: Lines that name dates, degrees or places.
why: Duties tell what the post was, not what was done in it.
shows: Was responsible for various tasks around customers.

JEV701
ask: Does this slide title only name a subject, so that one has to study the slide to learn what it says about it?
counts: Nouns and noun phrases such as Results, Market overview, Next steps.
spare: Titles that make a statement; title slides, dividers and agendas.
why: In many decks only the titles are read.
shows: Visitor numbers

JEV702
ask: Does the body of this section or slide leave its title unproved, or speak of something else?
counts: Titles that claim or promise what the body doesn't show.
spare: Bodies that support the title in part and say so.
why: The title is what is remembered, and here it would be remembered wrongly.
shows: Title: Repairs have paid off. Body: Since 2019 we have repaired doors, windows and two roofs.

JEV703
ask: Does this slide make two or more main points that would each need their own slide?
counts: Halves that share no conclusion.
spare: Several facts for one conclusion; overviews that are meant as such.
why: One can only present one point at a time.
shows: Ticket sales fell in winter. - The new crew begins in May and needs lockers.

JEV704
ask: Is this heading a verdict, a tease or an epitaph where readers look for a plain label?
counts: Headings that make them guess, pronounce judgement or declare something dead.
spare: Headings that name their content, also as a statement.
why: Headings are for finding things.
shows: The valve that wasn't

JEV705
ask: Is the main noun of this heading an abstraction that doesn't tell what the section is about?
counts: Availability, considerations, overview, handling, management of something.
spare: Headings with a concrete noun or a verb.
why: Such a heading fits every section.
shows: Door opening behaviour considerations

JEV711
ask: Read in order and alone, do the titles of this deck fail to give its argument?
counts: Rows of topics without claims, leaps, and titles that are the same on several slides.
spare: Decks whose titles tell the story, also tersely.
why: Whoever missed the talk will read only these.
shows: Overview / Background / Data / Data / Outlook
"""


@dataclass(frozen=True)
class Question:
    ask: str
    counts: str = ""
    spare: str = ""
    why: str = ""
    shows: tuple[str, ...] = ()

    def instructions(self) -> str:
        """What is sent to a model."""
        return "\n".join(x for x in (self.ask, self.counts and f"This counts: {self.counts}", self.spare and f"This doesn't count: {self.spare}") if x)


def _parsed(text: str) -> dict[str, Question]:
    out = {}
    for entry in text.strip().split("\n\n"):
        code, *lines = entry.split("\n")
        parts = [line.partition(": ")[::2] for line in lines]
        out[code] = Question(**{k: v for k, v in parts if k != "shows"}, shows=tuple(v for k, v in parts if k == "shows"))
    return out


QUESTIONS = _parsed(TEXT)
